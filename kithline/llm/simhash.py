"""Near duplicates by SimHash, with pigeonring filtering.

Two 64-bit fingerprints that differ in at most two bits are cut, as a ring, into seven
segments.  By the pigeonring principle some segment begins a chain along the ring in which
every first l segments differ in at most floor(2 * l / 7) bits: none in the first three,
one in the first six, two in all.  So three consecutive equal segments (27 or 28 bits) are
the key of the candidate join, and the chain's next budget prunes the candidates before
the full Hamming check.

Fingerprints are distinct before they are joined, so copies cost nothing.  A key that
more than bucket_limit fingerprints share is not joined with itself; each of these
fingerprints is instead linked through the 65 values at distance one or less from it.
Two fingerprints share such a value exactly if they differ in two bits or less, and a value
has 65 fingerprints at most, so this is exact and linear whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.components import components
from kithline.llm.scratch import free_name, materialise
from kithline.llm.shipping import ship
from kithline.llm.skew import join_groups
from kithline.llm.words import word_runs
from kithline.llm.workers import sole

SEGMENTS = 7
DISTANCE = 2
SHINGLE_WORDS = 3
SEED = 42
BUCKET_LIMIT = 64

_SPREAD = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set; eight bits are counted in each byte of a word."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at: at + 65_536]
        for j in range(8):
            lanes = (block >> np.uint64(j)) & _SPREAD
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
            total[j::8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return total


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes as a signed number; zero of none."""
    value = sum(1 << int(i) for i in np.flatnonzero(2 * _bit_counts(hashes) > len(hashes)))
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as a signed 64-bit number."""
    import xxhash

    digest, total, n, carry, words = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, [], []
    for run in word_runs((text or "").encode().lower()):
        words = carry + run
        if len(words) >= shingle_words:
            found = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle_words)), strict=False)]
            total += _bit_counts(np.frombuffer(b"".join(found), ">u8").astype(np.uint64))
            n += len(found)
        carry = words[max(0, len(words) - shingle_words + 1):]
    if not n and words:
        total, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)), 1
    bits = np.flatnonzero(2 * total > n)
    value = sum(1 << int(i) for i in bits)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    ship(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sole("simhash", run), f"doc_id {ids}, fp long")


def _masks(segments: int) -> list[list[int]]:
    """For each start on the ring, the bits of its first 1, 2, ... segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    own = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(segments)]
    return [[sum(own[(i + k) % segments] for k in range(n)) for n in range(1, segments + 1)] for i in range(segments)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: str, b: str, mask: Column | None = None) -> Column:
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(x if mask is None else x.bitwiseAND(mask))


def near_links(values: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) such that the components of these links are those of all pairs within the distance.

    values: distinct fp.  Pairs within the distance are returned themselves, but for those
    that meet only under keys with more than bucket_limit values: they are connected
    through values between them (which need not occur), hence distance must be 2.
    """
    if distance != 2:
        raise ValueError("the link through a value between two fingerprints is for a distance of 2")
    exact = next(n for n in range(segments, 0, -1) if distance * n // segments == 0)
    one = next(n for n in range(segments, 0, -1) if distance * n // segments <= 1)
    masks = _masks(segments)
    pick = lambda n: F.element_at(F.array(*(F.lit(_signed(m[n - 1])) for m in masks)), F.col("ring") + 1)
    rings = F.explode(F.array(*(F.lit(i) for i in range(segments)))).alias("ring")
    keyed = values.select("fp", rings).withColumn("key", F.col("fp").bitwiseAND(pick(exact)))
    sizes = materialise(keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    several = keyed.join(sizes, ["ring", "key"])
    few = several.filter(F.col("n") <= bucket_limit)
    pairs = few.select("ring", "key", F.col("fp").alias("a")).join(few.select("ring", "key", F.col("fp").alias("b")), ["ring", "key"]).filter("a < b")
    pairs = pairs.filter(_differ("a", "b", pick(one)) <= distance * one // segments).filter(_differ("a", "b") <= distance).select("a", "b")
    crowded = several.filter(F.col("n") > bucket_limit).select("fp").distinct()
    steps = F.explode(F.array(*(F.lit(_signed(s)) for s in (0, *(1 << i for i in range(64)))))).alias("step")
    near = crowded.select("fp", steps).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
    centre = near.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("point", "a")
    stars = near.join(centre, "point").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    docs needs doc_id and text.  Words are split at space and 0x09 to 0x0D after A-Z became
    lower case.  A text with fewer words than a shingle is one shingle; a text without words
    (null and empty too) has fingerprint zero and is linked like any other.  component_id is
    the smallest doc_id reachable, null only where every doc_id reachable is null.  Rows that
    repeat a doc_id are linked by their own texts.  No rows give no rows.
    """
    prints = materialise(fingerprints(docs, shingle_words), "prints")
    values = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "values")
    count = values.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    reached = materialise(components(near_links(values.select("fp"), bucket_limit=bucket_limit)), "components")
    of = values.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("component"))
    of = materialise(of, "members")
    groups = materialise(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "groups")
    ids = materialise(join_groups(of.select("component", "fp", "rows"), groups, ["component"], "size", count).select("fp", "rows", "component_id"), "ids")
    return join_groups(prints, ids, ["fp"], "rows", count).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT, similarity: float | None = None) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns.

    Fingerprints within two bits are linked or, with a similarity, texts whose sets of shingles
    have at least that Jaccard similarity: they meet by fingerprints within two bits, and, as most
    such pairs differ in more bits than fingerprints can be looked up by, by minima of their
    shingles; either way they are compared by their shingles (see similar).  Rows
    whose doc_id is null are all kept.  A doc_id that several rows have goes if any of them is
    linked to a smaller one.
    """
    if similarity is not None:
        from kithline.llm.similar import drop_similar

        return drop_similar(docs, similarity, shingle_words, bucket_limit)
    goes = free_name(docs, "goes")
    ids = near_duplicates(docs, shingle_words, bucket_limit).filter("component_id < doc_id").select(F.col("doc_id").alias(goes)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(goes), "left_anti")
