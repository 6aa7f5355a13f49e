"""License notices by diagonal voting, with DataFrame functions only.

Each three consecutive words of a document are hashed and joined with those of the
templates: the notices of common licences, read from notices.txt, and short phrases.  A hit at
word p of the document and word t of the template votes for the diagonal p - t; a notice stands
where one diagonal has many votes.  Words that were added or left out move the rest of a notice
to a neighbouring diagonal, so neighbours are merged, as far as a notice may be spread.  The
span is verified then: hits are compared word by word, and only those count that follow each other in the
document as they do in the template.  Their share of the template is compared with the threshold.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
SHARE = 0.8
#: Diagonals at most so far apart are neighbours.
DRIFT = 2

#: The phrases whose places are counted, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Further notices and their labels.
NOTICES = (
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and what is beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATOR, -1), "")


def templates() -> list[tuple[list[str], str]]:
    """(words, label) of the base phrases, the further phrases and the notices, in this order."""
    out = [(phrase.split(" "), label) for phrase, label in BASE + NOTICES]
    for part in Path(__file__).with_name("notices.txt").read_text().split("== ")[1:]:
        label, text = part.split("\n", 1)
        out.append((re.findall(r"[a-z0-9]+", text.lower()), label))
    return out


def _templates(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template; their number is fixed, so they can be broadcast."""
    rows = []
    for i, (words, label) in enumerate(templates()):
        grams = len(words) - GRAM + 1
        rows += [(i, i < len(BASE), label, grams, t, *words[t: t + GRAM]) for t in range(grams)]
    own = spark.createDataFrame(rows, "template int, is_base boolean, label string, n_grams int, t int, t0 string, t1 string, t2 string")
    return own.withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def scan_licenses(docs: DataFrame, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of docs.

    docs needs doc_id and text.  n_base counts the places where a base phrase stands,
    first_word and last_word are the smallest and largest of their starts (null without
    any).  labels adds those of templates of which at least share is hit, in order, on merged
    diagonals; score is the largest share.  A null or empty text has no words, no labels and
    score 0.  Repeated rows are scanned each.  No rows give no rows.
    """
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("w"))
    size = F.size("w")
    grams = words.select("rid", "doc_id", size.cast("long").alias("n_words"), F.posexplode_outer(
        F.arrays_zip(F.col("w").alias("w0"), F.slice("w", F.lit(2), F.greatest(size, F.lit(1))).alias("w1"), F.slice("w", F.lit(3), F.greatest(size, F.lit(1))).alias("w2"))).alias("p", "g"))
    grams = grams.select("rid", "doc_id", "n_words", "p", "g.w0", "g.w1", "g.w2").withColumn("hash", F.xxhash64("w0", "w1", "w2"))
    same = [F.col("d.hash") == F.col("t.hash")] + [F.col(f"d.w{i}") == F.col(f"t.t{i}") for i in range(GRAM)]
    hits = grams.alias("d").join(F.broadcast(_templates(docs.sparkSession)).alias("t"), same, "left")
    # One row for each document without hits, made before the shuffle, so documents are read once.
    votes = hits.groupBy("rid", "doc_id", "n_words", "template", "is_base", "label", "n_grams", (F.col("p") - F.col("t")).alias("diagonal"), "t").agg(F.lit(1).alias("_"))
    whole = votes.groupBy("rid", "doc_id", "n_words", "template", "is_base", "label", "n_grams", "diagonal").agg(F.count("t").alias("votes"), F.collect_list("t").alias("ts"))
    by = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > drift).cast("int"), F.lit(0))
    merged = whole.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by))
    # A notice is spread over as many further words as it has itself at most; a longer run of diagonals is cut.
    first = F.min("diagonal").over(Window.partitionBy("rid", "template", "run"))
    merged = merged.withColumn("cluster", F.struct("run", F.floor((F.col("diagonal") - first) / (F.col("n_grams") + drift)).alias("part")))
    hits_of = F.transform("ts", lambda t: F.struct(t.cast("long").alias("t"), (t + F.col("diagonal")).cast("long").alias("p")))
    start = F.struct(F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    follows = lambda s, x: F.when((x["t"] > s["t"]) & (x["p"] > s["p"]), F.struct(x["t"].alias("t"), x["p"].alias("p"), (s["n"] + 1).alias("n"))).otherwise(s)
    in_order = F.aggregate(F.array_sort(F.flatten(F.collect_list("hits"))), start, follows, lambda s: s["n"])
    merged = merged.withColumn("hits", hits_of)
    clusters = merged.groupBy("rid", "doc_id", "n_words", "template", "is_base", "label", "n_grams", "cluster").agg(
        in_order.alias("hit"),
        F.count_if(F.col("is_base") & (F.col("votes") == F.col("n_grams"))).alias("places"),
        F.min(F.when(F.col("is_base") & (F.col("votes") == F.col("n_grams")), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("is_base") & (F.col("votes") == F.col("n_grams")), F.col("diagonal"))).alias("last"))
    part = F.coalesce(F.col("hit") / F.col("n_grams"), F.lit(0.0))
    base = F.when(F.col("places") > 0, F.col("label"))
    out = clusters.groupBy("rid", "doc_id", "n_words").agg(
        F.sum("places").cast("long").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((part >= share) | base.isNotNull(), F.col("label")))), ",").alias("labels"),
        F.max(part).alias("score"))
    return out.drop("rid")
