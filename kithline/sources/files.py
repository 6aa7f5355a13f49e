"""Readers of label, alignment, attribute and triple files, pair sets, imports and model versions.

All read whole folders or files by any path that Spark can open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<name:string,designation:string,equipment_type:string,category:string,status:string,aliases:array<string>>"
#: The sections of an import file, all optional.
IMPORT_SCHEMA = """
equipment array<struct<name:string,designation:string,category:string,state:string,aliases:array<string>>>,
positions array<struct<name:string,designation:string,lat:double,lng:double,reported_at:string>>,
locations array<struct<name:string,loc_type:string,region:string,coordinates:string>>,
activities array<struct<name:string,event_type:string,start_date:string,end_date:string>>,
articles array<struct<title:string,url:string,content:string,published_at:string,source:string>>
"""


def _columns(spark: SparkSession, path: str) -> DataFrame:
    """(line, c): the tab-separated columns of each line, in the files' order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t", -1).alias("c"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(uri, label, trans): three columns or more; with two the label is its own translation; the last line of a uri wins."""
    rows = _columns(spark, path).filter(F.size("c") >= 2)
    trans = F.when(F.size("c") >= 3, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1)))
    return rows.groupBy(F.get("c", F.lit(0)).alias("uri")).agg(F.max_by(F.struct(F.get("c", F.lit(1)).alias("label"), trans.alias("trans")), "line").alias("v")).select("uri", "v.*")


def alignment(spark: SparkSession, path: str) -> DataFrame:
    """(uri_a, uri_b) of lines with exactly two columns."""
    return _columns(spark, path).filter(F.size("c") == 2).select(F.get("c", F.lit(0)).alias("uri_a"), F.get("c", F.lit(1)).alias("uri_b"))


def local_name(uri: Column) -> Column:
    return F.lower(F.element_at(F.split(uri, "/"), -1))


def attributes(spark: SparkSession, path: str, local: bool = False) -> DataFrame:
    """(uri, attributes): the set of the further columns, on request as lower-case local names."""
    own = F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0)))
    return _columns(spark, path).filter(F.size("c") >= 2).select(F.get("c", F.lit(0)).alias("uri"), F.array_distinct(F.transform(own, local_name) if local else own).alias("attributes"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of lines with exactly three columns."""
    return _columns(spark, path).filter(F.size("c") == 3).select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate("spo")))


def import_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of a JSON import, each as rows with their ordinal."""
    whole = spark.read.schema(IMPORT_SCHEMA).option("multiLine", True).json(path)
    return {c: whole.select(F.posexplode(c).alias("ordinal", "r")).select("ordinal", "r.*") for c in whole.columns}


def pair_set(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, vid, name, type and props of both sides); an 'event' type reads 'activity'; props are maps."""
    side = ", ".join(f"vid_{s}:string,name_{s}:string,type_{s}:string,props_{s}:map<string,string>" for s in "ab")
    rows = spark.read.schema(f"same_type_pairs array<struct<pair_id:string,{side}>>").option("multiLine", True).json(path).select(F.explode("same_type_pairs").alias("p")).select("p.*")
    return rows.withColumn("entity_type", F.when(F.col("type_a") == "event", "activity").otherwise(F.col("type_a")))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, label): same is 1, different 0, others are left out."""
    rows = spark.read.schema("records array<struct<pair_id:string,final_label:string>>").option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")
    return rows.filter(F.col("final_label").isin("same", "different")).select("pair_id", (F.col("final_label") == "same").cast("int").alias("label"))


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value.*) of a JSON object whose keys are ids; value: the schema of its values."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def newest_version(versions: DataFrame, prefix: str) -> DataFrame:
    """The lexicographically last version with the prefix."""
    own = versions.filter(F.col("version").startswith(prefix))
    return own.orderBy(F.desc("version")).limit(1)
