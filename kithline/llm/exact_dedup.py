"""Exact duplicates by deterministic block naming.

The bytes of each normalised text are cut into blocks of fixed size.  Distinct blocks are
sorted and numbered; that number is the block's name.  Adjacent names are then paired,
distinct pairs are sorted and numbered, and so on, until each document has one name.  A
name stands for one byte sequence only, so two documents of the same level have the same
name exactly if their texts are equal.

Blocks travel once, as distinct blocks that are combined before the shuffle; everything
after that moves integers.  The names are looked up by the 64-bit hash of a block.  Hashes
that stand for two different blocks are found while the distinct blocks are counted, and
only their blocks are compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.scratch import free_name, materialise
from kithline.llm.skew import join_groups

#: White space that separates words, as a regular expression's class.
SPACE = r"[\x20\x09-\x0D]"

BLOCK_BYTES = 4096


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty.

    A run that is one space already is left alone, which is nearly all of them.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D]{SPACE}*|\x20{SPACE}+", " ")


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(data: Column, size: int) -> Column:
    count = F.greatest(F.ceil(F.length(data) / F.lit(size)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort the distinct keys and number them; each number is used once."""
    return distinct.select(*keys).orderBy(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(texts: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, sha, m, idx, n, name) for each block of each document."""
    seq = rows.select("doc_id", "sha", "m", F.col("n_blocks").alias("n"), F.posexplode("hashes").alias("idx", "h"))
    pieces = texts.select(F.explode(_blocks(F.col("data"), size)).alias("block")).select(_hash(F.col("block")).alias("h"), "block")
    counted = materialise(pieces.distinct().groupBy("h").agg(F.count("*").alias("n_texts")), "blocks")
    shared = counted.filter("n_texts > 1").select("h")
    if shared.isEmpty():
        return seq.join(_numbered(counted, ["h"]), "h").select("doc_id", "sha", "m", "idx", "n", "name")
    # Some hash stands for several blocks: those are told apart by their bytes.
    located = texts.select("doc_id", "sha", F.posexplode(_blocks(F.col("data"), size)).alias("idx", "block")).withColumn("h", _hash(F.col("block")))
    bytes_of = located.join(shared, "h", "left_semi")
    plain = materialise(counted.filter("n_texts = 1").select("h", F.lit(None).cast("binary").alias("block"))
                        .unionByName(bytes_of.select("h", "block").distinct()).transform(lambda d: _numbered(d, ["h", "block"])), "names")
    one = seq.join(shared, "h", "left_anti").join(plain.filter("block is null").select("h", "name"), "h")
    told = bytes_of.distinct().join(plain.filter("block is not null"), ["h", "block"]).select("doc_id", "sha", "idx", "name")
    several = seq.join(shared, "h", "left_semi").alias("s").join(
        told.alias("t"), F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.sha") == F.col("t.sha")) & (F.col("s.idx") == F.col("t.idx"))
    ).select("s.doc_id", "s.sha", "s.m", "s.idx", "s.n", "t.name")
    return one.select("doc_id", "sha", "m", "idx", "n", "name").unionByName(several)


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    docs needs doc_id and text.  A null text counts as empty.  Of rows with equal
    normalised texts the one with the smallest doc_id stays; a null doc_id counts as the
    largest.  Rows that share doc_id and text are returned as often as they occur and
    count as often in group_size; one of them stays.  No rows give no rows.
    """
    return _resolved(*_named(docs, block_bytes))


def _named(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, bool, int]:
    """(doc_id, sha, m, level, name), whether any row repeats doc_id and text, and the number of rows."""
    texts = docs.select("doc_id", normalise(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("sha"), F.encode("t", "UTF-8").alias("data"))
    rows = texts.select("doc_id", "sha", F.transform(_blocks(F.col("data"), block_bytes), _hash).alias("hashes"))
    rows = materialise(rows.groupBy("doc_id", "sha", "hashes").agg(F.count("*").alias("m")).withColumn("n_blocks", F.size("hashes")), "documents")
    longest, most, count = rows.agg(F.max("n_blocks"), F.max("m"), F.count("*")).first()
    longest = longest or 1

    seq, done, level = materialise(_first_names(texts, rows, block_bytes), "level0"), [], 0
    while True:
        done.append(seq.filter("n = 1").select("doc_id", "sha", "m", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        side = F.col("idx") % 2 == 0
        pairs = seq.filter("n > 1").groupBy("doc_id", "sha", "m", F.col("idx").cast("int").bitwiseAND(-2).alias("even"), "n").agg(
            F.max(F.when(side, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~side, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = pairs.select("doc_id", "sha", "m", (F.col("even") / 2).cast("int").alias("idx"), F.ceil(F.col("n") / 2).cast("int").alias("n"), "a", "b")
        seq = materialise(pairs.join(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"]).drop("a", "b"), f"level{level}")

    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return named, (most or 1) > 1, count


def _resolved(named: DataFrame, repeated: bool, count: int) -> DataFrame:
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.count("*").alias("rows"))
    groups = materialise(groups, "groups")
    copies = F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))) if repeated else F.lit(1)
    out = join_groups(named, groups, ["level", "name"], "rows", count).withColumn("copy", copies)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    See exact_dedup for null, empty and repeated rows.  No rows give no rows.
    """
    named, repeated, count = _named(docs, block_bytes)
    own, keep_id, keep_sha = (free_name(docs, n) for n in ("own_sha", "keep_id", "keep_sha"))
    stays = _resolved(named, repeated, count).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    keyed = docs.withColumn(own, F.sha2(normalise(F.col("text")), 256))
    kept = keyed.join(stays, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_sha)), "left_semi")
    # Rows that repeat both doc_id and text pass the join together; one of each stays.
    return (kept.dropDuplicates(["doc_id", own]) if repeated else kept).drop(own)
