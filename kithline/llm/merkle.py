"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over their roots.

Each level is one DataFrame: nodes carry their row number within the tree, the number divided by the
fanout names the parent, and the children of a parent, sorted, are hashed into it.  The way back
joins each level's parents, with the siblings already known above them, to their children, so what a
leaf's proof needs is put together for an eighth of the rows at each step and for the leaves last.
Nothing but the largest tree's size comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.scratch import materialise

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field with its length in bytes before it, - for null: no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """With i, a row's place in its group g in this order, and n, the group's size.

    Ranges of (g, order) are cut over all rows, so a large group lies in many of them; each range
    numbers its own rows on from where the ranges before it end.  The ranges are written first,
    as their borders are drawn anew whenever they are computed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()), name)
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("g", "part").agg(F.count("*").alias("own"))
    sizes = sizes.select("g", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"), F.sum("own").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    return cut.withColumn("r", place).join(sizes, ["g", "part"]).withColumn("i", F.col("first") + F.col("r")).drop("part", "r", "first")


def _rise(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels' parents with their children, and for each level the trees that end there (g, h).

    nodes: g, i, n, h and load, which only the first level's children have.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.filter("n = 1").select("g", "h", "load")]
    while largest > 1:
        own = ["i", "h"] if levels else ["i", "h", "load"]
        kids = F.sort_array(F.collect_list(F.struct(*own)))
        parents = nodes.filter("n > 1").groupBy("g", F.floor(F.col("i") / fanout).alias("p"), "n").agg(kids.alias("kids"))
        parents = materialise(parents.withColumn("h", digest(F.array_join("kids.h", ""))), f"{name}{len(levels)}")
        levels.append(parents)
        largest = -(-largest // fanout)
        nodes = parents.select("g", F.col("p").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), "h")
        tops.append(nodes.filter("n = 1").select("g", "h"))
    return levels, tops


def _descend(levels: list[DataFrame], tops: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, h, load, path, and the columns of above) of each leaf; above: g, path and more for each tree."""
    extra = [c for c in above.columns if c not in ("g", "path")]
    start = lambda k: tops[k].drop("load").join(above, "g").withColumn("i", F.lit(0).cast("long"))
    known = start(len(levels)) if levels else None
    for k in range(len(levels) - 1, -1, -1):
        up = known.select("g", F.col("i").alias("p"), "path", *extra)
        both = levels[k].select("g", "p", "kids").join(up, ["g", "p"]).select("*", F.posexplode("kids").alias("at", "kid"))
        hashes = F.col("kids.h")
        side = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice(hashes, F.col("at") + 2, F.size("kids")), "").alias("after"))
        down = both.select("g", "kid.*", F.concat(F.array(side), "path").alias("path"), *extra)
        if k:
            columns = ["g", "i", "h", "path", *extra]
            known = down.select(*columns).unionByName(start(k).select(*columns))
        else:
            known = down
    columns = ["g", "h", "load", "path", *extra]
    lone = tops[0].join(above, "g").select(*columns)
    return lone if known is None else known.select(*columns).unionByName(lone)


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path), one row per row of docs, and the columns carry computes of docs.

    docs needs doc_id, source, lang, n_chars and text.  path: the digests of the siblings before and
    after the node, from the leaf to the root; a null in any field is a value of its own, and rows
    without a lang are a tree of their own, the first.  Within a tree leaves ascend by doc_id, null
    first, then by their digest; rows that are wholly alike stand side by side.  A tree of one leaf is
    that leaf, and a single tree is the root.  Further columns of docs are not looked at.  No rows
    give no rows.
    """
    carry = carry or {}
    # A lang with a sign before it, so that null is the empty string: the same order, and a key that joins.
    g = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), "doc_id", leaf(*map(F.col, FIELDS)).alias("h"), F.struct("doc_id", *(c.alias(k) for k, c in carry.items())).alias("load"), F.monotonically_increasing_id().alias("row"))
    placed = materialise(_numbered(rows, ["doc_id", "h", "row"], "leaves").drop("row", "doc_id"), "placed")
    levels, tops = _rise(placed, fanout, "level")

    ends = tops[0].select("g", "h")
    for more in tops[1:]:
        ends = ends.unionByName(more)
    roots = ends.select(F.lit("").alias("g"), F.col("g").alias("tree"), "h", F.struct(F.col("g").alias("tree")).alias("load"))
    upper, peaks = _rise(materialise(_numbered(roots, ["tree"], "subroots").drop("tree"), "trees"), fanout, "upper")
    root = peaks[0].select("h")
    for more in peaks[1:]:
        root = root.unionByName(more.select("h"))
    sky = root.select(F.lit("").alias("g"), F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    trees = _descend(upper, peaks, sky).select(F.col("load.tree").alias("g"), F.col("h").alias("subroot"), "root", "path")
    found = _descend(levels, tops, materialise(trees, "roots"))
    return found.select("load.doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", *(f"load.{k}" for k in carry))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda h, s: digest(s["before"], h, s["after"]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, tampered: Column, change: Column, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof held against its content now.

    Where tampered is true the text has become change since the manifest was made; a null
    condition counts as false.  See merkle_manifest for nulls, ties and empty input.
    """
    now = leaf(*(F.col(f) for f in FIELDS if f != "text"), F.when(tampered, change).otherwise(F.col("text")))
    made = merkle_manifest(docs, fanout, {"now": now})
    out = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
