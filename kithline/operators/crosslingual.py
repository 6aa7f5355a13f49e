"""Alignment of entities of two knowledge graphs in different languages.

A side has uri, label, attributes (an array) and degree.  Pairs carry both sides' columns
with the suffixes _a and _b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.text import fold_name, jaccard, ratio, uri_tokens

WEIGHTS = {"name": 0.40, "attr": 0.35, "degree": 0.15, "uri": 0.10}


def name_tokens(label: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(fold_name(label), r"(?U)\s+"), ""))


def signals(pairs: DataFrame, local_names: bool = True, uris: bool = True) -> DataFrame:
    """With name_similarity, attr_overlap, degree_similarity, uri_similarity and l1_score; uris: whether the URIs count."""
    na, nb = fold_name(F.col("label_a")), fold_name(F.col("label_b"))
    ta, tb = name_tokens(F.col("label_a")), name_tokens(F.col("label_b"))
    name = F.when((na == nb) & (F.size(ta) > 0), F.lit(1.0)).otherwise(jaccard(ta, tb))
    local = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.lower(F.element_at(F.split(x, "/"), -1))))
    attr = jaccard(local(F.col("attributes_a")), local(F.col("attributes_b"))) if local_names else jaccard(F.col("attributes_a"), F.col("attributes_b"))
    out = pairs.withColumns({"name_similarity": name, "attr_overlap": attr, "degree_similarity": ratio(F.col("degree_a"), F.col("degree_b")), "uri_similarity": jaccard(uri_tokens(F.col("uri_a")), uri_tokens(F.col("uri_b")))})
    score = F.col("name_similarity") * WEIGHTS["name"] + F.col("attr_overlap") * WEIGHTS["attr"] + F.col("degree_similarity") * WEIGHTS["degree"]
    if uris:
        score = score + F.col("uri_similarity") * WEIGHTS["uri"]
    alone = (F.col("attr_overlap") == 0) & ((F.col("degree_a") > 5) | (F.col("degree_b") > 5))
    return out.withColumn("l1_score", F.when(alone, score * 0.7).otherwise(score))


def features(pairs: DataFrame) -> DataFrame:
    """The signals and what the learned aligner sees besides."""
    s = signals(pairs, local_names=False)
    na, nb = fold_name(F.col("label_a")), fold_name(F.col("label_b"))
    xa, xb = F.size("attributes_a"), F.size("attributes_b")
    flag = lambda c: c.cast("double")
    return s.withColumns({
        "name_exact": flag((na == nb) & (na != "")), "name_contains": flag((na != "") & (nb != "") & (F.contains(na, nb) | F.contains(nb, na))),
        "attr_count_diff": F.abs(xa - xb).cast("double"), "degree_diff": F.abs(F.col("degree_a") - F.col("degree_b")).cast("double"), "attr_count_a": xa.cast("double"), "attr_count_b": xb.cast("double"),
        "shared_attr_ratio": F.when((xa > 0) & (xb > 0), F.size(F.array_intersect("attributes_a", "attributes_b")) / F.least(xa, xb)).otherwise(F.lit(0.0))})


def decide(score: Column, merge: float = 0.5, reject: float = 0.3) -> Column:
    """A score of exactly reject is escalated."""
    return F.when(score >= merge, "merge").when(score < reject, "reject").otherwise("escalate")


def block_key(label: Column) -> Column:
    return F.substring(F.get(F.split(F.trim(fold_name(label)), " "), F.lit(0)), 1, 3)


def negatives(left: DataFrame, right: DataFrame, gold: DataFrame, most: int = 2000, seed: int = 42) -> DataFrame:
    """(uri_a, uri_b) with a common block key that are not in gold (in either direction): most of them, or all there are.

    A walk through a block deals its left entities in turn, in a seeded order, and gives each its right
    entities from a seeded start on, so it meets every pair of the block once; the block gives the first pairs of
    its walk that are not in gold.  Each block gives one pair at least while most allows, and beyond that by its
    number of pairs.  Only the pairs that are looked at are ever made.
    """
    from kithline.operators.listing import numbered
    from kithline.scratch import materialise

    side = lambda d, e: d.select(F.col("uri").alias(f"uri_{e}"), block_key(F.col("label")).alias("k")).filter("k <> ''").distinct()
    a, b = side(left, "a"), side(right, "b")
    sizes = a.groupBy("k").agg(F.count("*").alias("na")).join(b.groupBy("k").agg(F.count("*").alias("nb")), "k").withColumn("pairs", F.col("na") * F.col("nb"))
    known = gold.select("uri_a", "uri_b")
    known = known.unionByName(known.select(F.col("uri_b").alias("uri_a"), F.col("uri_a").alias("uri_b"))).distinct()
    taken = known.join(a, "uri_a").join(b.withColumnRenamed("k", "kb"), "uri_b").filter("k = kb").groupBy("k").agg(F.count("*").alias("taken"))
    free = materialise(sizes.join(taken, "k", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("free", F.col("pairs") - F.col("taken")).filter("free > 0"), "blocks")
    blocks, total = free.agg(F.count("*"), F.coalesce(F.sum("free"), F.lit(0))).first()
    # Shares of what is left after one each, by running sums over the blocks in the order of their keys.
    rest, spare = max(min(most, total) - blocks, 0), max(total - blocks, 1)
    part = Window.orderBy("k")  # a row for each block key: three characters of a word
    run = F.sum(F.col("free") - 1).over(part.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)")
    cut = lambda x: F.floor(x * rest / spare)
    share = (cut(run) - cut(run - (F.col("free") - 1)) + F.when(F.row_number().over(part) <= most, 1).otherwise(0)).cast("long")
    wanted = free.withColumn("want", F.least(share, F.col("free"))).filter("want > 0")
    drawn = wanted.select("k", "na", "nb", "want", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("want") + F.col("taken"), F.col("pairs")) - 1)).alias("t"))
    at = drawn.withColumn("i", F.col("t") % F.col("na")).withColumn("j", F.pmod(F.floor(F.col("t") / F.col("na")) + F.pmod(F.xxhash64("k", "i", F.lit(seed + 1)), F.col("nb")), F.col("nb")))
    pairs = at.join(numbered(a, "uri_a", "k", name="i", seed=seed), ["k", "i"]).join(numbered(b, "uri_b", "k", name="j", seed=seed), ["k", "j"]).join(known, ["uri_a", "uri_b"], "left_anti")
    # A block's looked-at pairs are at most what it gives and the gold pairs in it.
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("t"))).filter("r <= want")
    return first.select("uri_a", "uri_b")


#: The features of the learned aligner; the fixed score is left out, as it is made of them.
ALIGNER = ("name_similarity", "attr_overlap", "degree_similarity", "uri_similarity", "name_exact", "name_contains", "attr_count_diff", "degree_diff", "attr_count_a", "attr_count_b", "shared_attr_ratio", "degree_a", "degree_b")


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(uri_a, uri_b, label)"""
    both = [d.select("uri_a", "uri_b", F.lit(y).alias("label")) for d, y in ((positives, 1), (negatives, 0))]
    return both[0].unionByName(both[1])


def escalated_confusion(scored: DataFrame, *by: str, merge: float = 0.5, reject: float = 0.3) -> DataFrame:
    """Counts of the decisions by score, and accuracy and interception; scored: score, label."""
    d, y = decide(F.col("score"), merge, reject), F.col("label")
    n = scored.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if((d == k) & (y == v)).alias(c) for c, k, v in (("tp", "merge", 1), ("fp", "merge", 0), ("tn", "reject", 0), ("fn", "reject", 1))), F.count_if(d == "escalate").alias("escalated"))
    decided = F.col("n") - F.col("escalated")
    return n.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / F.greatest(decided, F.lit(1)), 4)).withColumn("interception", F.round(decided / F.col("n"), 4))


def cross_validated(pairs: DataFrame, k: int = 5, key: str = "pair_id") -> DataFrame:
    """(fold, n, tp, ..., accuracy, interception): logistic aligners of the other folds, neither scaled nor balanced.

    pairs: as for features, with key and label.
    """
    from kithline.operators.learning import dealt, out_of_fold
    from kithline.scratch import materialise

    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ALIGNER))
    rows = features(pairs).select(F.col(key).alias("pair_id"), "label", x.alias("z"))
    rows = materialise(dealt(rows, "fold", k), "folds")
    return escalated_confusion(out_of_fold(rows, len(ALIGNER), k, balanced=False).withColumnRenamed("p", "score"), "fold")
