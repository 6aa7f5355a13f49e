"""Look-ups by an index in files: exact values, and texts within values by their 3-grams.

The index is two tables below one path, both partitioned by a bucket and sorted within files:
values (value_bucket, key, vid, field, value), the rows of an exact value side by side, and grams (gram_bucket, gram,
key, field), a row for each different 3-gram of a value.  A look-up first asks which buckets its keys fall in (their
number is bounded by the index), reads these folders only, and of their files the row groups that can hold its keys.  A third table counts the grams: a search asks for the rarest grams of its text, and what they find is compared
as a text.  Values are compared in lower case.  Null and empty values are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.scratch import materialise

BUCKETS, PER_FILE, RAREST = 64, 4_000_000, 3


def _grams(value: Column) -> Column:
    """The different 3-grams of a value, none if it is shorter."""
    return F.when(F.char_length(value) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(value) - 2), lambda i: F.substring(value, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, by: str, order: tuple[str, ...], path: str, per_file: int) -> None:
    """rows below path by bucket; a bucket is several files if it has more rows than one may have, so no value is one task's."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / per_file).cast("int").alias("_files"))
    dealt = rows.join(F.broadcast(sizes), by).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_files")))
    dealt.repartition(by, "_part").drop("_files", "_part").sortWithinPartitions(by, *order).write.partitionBy(by).parquet(path)


def build(rows: DataFrame, fields: tuple[str, ...], path: str, buckets: int = BUCKETS, per_file: int = PER_FILE) -> None:
    """Write the index of some columns of rows (vid and fields) below path, which must not be there yet."""
    each = rows.select(F.col("vid").cast("string").alias("vid"), F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.lower(F.col(f).cast("string")) for f in fields)))).alias("field", "value"))
    each = each.filter("vid is not null and value <> ''").distinct().withColumn("key", F.xxhash64("field", "value"))
    _written(each.select(_bucket(F.col("key"), buckets).alias("value_bucket"), "key", "vid", "field", "value"), "value_bucket", ("key", "vid"), f"{path}/values", per_file)
    values = _table(rows.sparkSession, path, "values")
    # Equal values are cut once: a posting leads to the key, and the key to all vertices that have the value.
    grams = values.select("key", "field", "value").distinct().select("key", "field", F.explode(_grams(F.col("value"))).alias("gram"))
    _written(grams.select(_bucket(F.col("gram"), buckets).alias("gram_bucket"), "gram", "key", "field"), "gram_bucket", ("gram", "key"), f"{path}/grams", per_file)
    counted = _table(rows.sparkSession, path, "grams").groupBy("gram_bucket", "gram").agg(F.count("*").alias("n"))
    counted.repartition("gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").parquet(f"{path}/counts")
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/form")


#: The tables; a schema of its own lets an empty one be read.
SCHEMAS = {
    "values": "key long, vid string, field string, value string, value_bucket int",
    "grams": "gram string, key long, field string, gram_bucket int",
    "counts": "gram string, n long, gram_bucket int",
}


def _table(spark: SparkSession, path: str, name: str, keys: DataFrame | None = None) -> DataFrame:
    """A table of the index, or its buckets that occur in keys; at most all numbers of buckets come to the driver."""
    table = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    if keys is None:
        return table
    by = table.columns[-1]
    return table.filter(F.col(by).isin([r[0] for r in keys.select(by).distinct().collect()]))


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/form").first().buckets


def equal(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(field, value, vid) for each wanted (field, value); values in lower case."""
    n = _buckets(spark, path)
    own = wanted.select("field", F.lower("value").alias("value")).filter("value <> ''").distinct().withColumn("key", F.xxhash64("field", "value"))
    own = own.withColumn("value_bucket", _bucket(F.col("key"), n))
    own = materialise(own, "wanted")
    return _table(spark, path, "values", own).join(own, ["value_bucket", "key", "field", "value"]).select("field", "value", "vid")


def containing(spark: SparkSession, path: str, texts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(q, field, value, vid) for each text q (column q of texts): the vertices with a value that contains it, q in lower case.

    Texts of less than three characters have no gram: for these, and only if there are any, all different
    values are read.  A text with a gram that no value has finds nothing without reading a posting.
    """
    n = _buckets(spark, path)
    asked = texts.select(F.lower("q").alias("q")).filter("q <> ''").distinct()
    asked = materialise(asked, "texts")
    cut = asked.select("q", F.size(_grams(F.col("q"))).alias("all"), F.explode(_grams(F.col("q"))).alias("gram")).withColumn("gram_bucket", _bucket(F.col("gram"), n))
    counted = cut.join(_table(spark, path, "counts", cut), ["gram_bucket", "gram"]).select("q", "all", "gram", "gram_bucket", "n")
    rare = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram", "gram_bucket"))), 1, rarest)
    known = counted.groupBy("q").agg(F.count("*").alias("here"), F.first("all").alias("all"), rare.alias("r")).filter("here = all")
    chosen = materialise(known.select("q", F.size("r").alias("need"), F.explode("r").alias("g")).select("q", "need", "g.gram", "g.gram_bucket"), "chosen")
    hits = _table(spark, path, "grams", chosen).join(chosen, ["gram_bucket", "gram"])
    keys = hits.groupBy("q", "field", "key").agg(F.count("*").alias("found"), F.first("need").alias("need")).filter("found = need").select("q", "field", "key")
    keys = materialise(keys.withColumn("value_bucket", _bucket(F.col("key"), n)), "hits")
    found = _table(spark, path, "values", keys).join(keys, ["value_bucket", "key", "field"]).filter(F.contains("value", F.col("q"))).select("q", "field", "value", "vid")
    short = asked.filter(F.char_length("q") < 3)
    if short.isEmpty():
        return found
    values = _table(spark, path, "values")
    # One- and two-character texts are many values' parts; they meet their values by the parts, not by comparing all.
    parts = lambda v, k: F.when(F.char_length(v) >= k, F.transform(F.sequence(F.lit(1), F.char_length(v) - (k - 1)), lambda i: F.substring(v, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    each = values.select("key", "field", "value").distinct()
    met = each.select("key", "field", F.explode(F.array_distinct(F.concat(parts(F.col("value"), 1), parts(F.col("value"), 2)))).alias("q")).join(short, "q")
    return found.unionByName(values.join(met, ["key", "field"]).select("q", "field", "value", "vid"))
