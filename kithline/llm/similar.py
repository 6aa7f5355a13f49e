"""Near duplicates by the exact Jaccard similarity of shingle sets; the wider search of operator 10.

A text is the set of its shingles of five words (fewer words are one shingle).  Each set has a
SimHash fingerprint, and fingerprints within two bits meet by operator 10's pigeonring filtering.
Most pairs of similarity 0.8 differ in more bits than that, so each set also has BANDS keys, each of the minima of ROWS hash functions.  Two sets of similarity 0.8 share a
key with a probability of 1 - (1 - 0.8**7)**54, all but 3e-6; whatever meets in either way is compared
exactly, on the sets themselves.  Only the keys are shuffled for all texts; texts are fetched
again for the sets that share a key.

Under each key one set, the pivot, is compared with all others first, and a second one where there
are many.  These links give each set a label, the smallest node a few links away.  After that only
sets with different labels need to be compared, which leaves out no pair that would join two groups,
so a large group of copies costs a comparison or two for each member and key.

What is left of a crowd, the many sets whose keys belong to one label, is not compared under each key.
There each set is what differs from the label's own set.  Two of these are similar only if they share
a known number of differences, hence one among the rarest few of each, and under these they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.components import components
from kithline.llm.scratch import free_name, materialise
from kithline.llm.shipping import ship
from kithline.llm.simhash import near_links, print_of
from kithline.llm.words import mix, pieces
from kithline.llm.workers import sole

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 54, 7
#: Keys of more sets than this get a second pivot; more sets than this with the same leading label are a crowd.
BUCKET_LIMIT = 64
#: Numbers of differences are dealt into classes of this part of the leading set's size.
CLASSES = 16
#: A label has come so many links.
LABEL_ROUNDS = 3

_U = np.uint64
_ODD = (np.random.default_rng(11).integers(1, 1 << 31, BANDS * ROWS, dtype=np.int64) * 2 + 1).astype(np.uint32)


def _permuted(x: np.ndarray, j: int) -> np.ndarray:
    """The j-th bijection of 32-bit numbers."""
    y = x * _ODD[j]
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x85EBCA6B)
    y ^= y >> np.uint32(13)
    return y


def _minima(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The minimum of each run of shingles under each hash function, a row for each run."""
    x = (found >> _U(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(_permuted(x, j), begins) for j in range(BANDS * ROWS)], 1)


def _keys(minima: np.ndarray) -> np.ndarray:
    """The BANDS keys of each row of minima."""
    rows = minima.astype(_U).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), rows.shape[:2])
    for r in range(ROWS):
        key = mix(key * _U(0xD6E8FEB86659FD93) + rows[:, :, r])
    return key


def _sets(column: pa.Array, shingle_words: int, keys: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, sorted distinct shingles, keys) of each text."""
    whole: dict[int, tuple[list[np.ndarray], np.ndarray | None]] = {}
    for p in pieces(column, shingle_words - 1, lower=True):
        for row in [r for r in whole if r != p.rows[0]]:
            own, least = whole.pop(row)
            yield row, np.unique(np.concatenate(own)), None if least is None else _keys(least[None])[0]
        words = p.words
        hashes = words.hashes()
        at, found = words.window_hashes(hashes, shingle_words)
        short = words.sequence_hashes(hashes)
        size = np.diff(words.first)
        if len(size) > 1 or size[0] < shingle_words:
            # Texts of fewer words than a shingle are one shingle.
            one = np.flatnonzero((size > 0) & (size < shingle_words))
            doc = np.concatenate([words.doc[at], one])
            order = np.argsort(doc, kind="stable")
            doc, found = doc[order], np.concatenate([found, short[one]])[order]
        else:
            doc = words.doc[at]
        cut = np.searchsorted(doc, np.arange(len(p.rows) + 1))
        some = np.flatnonzero(np.diff(cut))
        minima = _minima(found, cut[some]) if keys and len(some) else None
        if len(p.rows) == 1:  # perhaps a part of a text
            own, least = whole.get(int(p.rows[0]), ([], None))
            if minima is not None:
                least = minima[0] if least is None else np.minimum(least, minima[0])
            whole[int(p.rows[0])] = ([*own, np.unique(found)], least)
            continue
        made = dict(zip(some, _keys(minima), strict=True)) if minima is not None else {}
        for d, row in enumerate(p.rows):
            yield int(row), np.unique(found[cut[d]: cut[d + 1]]), made.get(d)
    for row, (own, least) in whole.items():
        yield row, np.unique(np.concatenate(own)), None if least is None else _keys(least[None])[0]


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, _U), *arrays]).view(np.int64))).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, node, size, fp, keys): a hash of the text's shingle set, its size, its fingerprint, and its keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes, sizes, prints, keys = [], [], [], [], []
            for row, own, k in _sets(batch.column(1), shingle_words, True):
                rows.append(row)
                nodes.append(_node(own))
                sizes.append(len(own))
                prints.append(print_of(own))
                keys.append(k if k is not None else np.zeros(0, _U))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), _longs(keys)], ["doc_id", "node", "size", "fp", "keys"])

    ship(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sole("similar", run), f"doc_id {ids}, node long, size long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, shingles) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, own, _ in _sets(batch.column(0), shingle_words, False)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _longs(sets)], ["node", "shingles"])

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(sole("similar", run), "node long, shingles array<long>")


def _pairs(left: DataFrame, right: DataFrame, similarity: float, unit: str = "label") -> DataFrame:
    """(a, b), a < b: distinct pairs with different labels and units under a common key whose sizes allow the similarity."""
    other = right.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"), F.col(unit).alias("unit_b"))
    met = left.select("key", F.col("node").alias("a"), "size", "label", F.col(unit).alias("unit")).join(other, "key").filter("label <> label_b AND unit <> unit_b")
    met = met.filter(F.least("size", "size_b") >= similarity * F.greatest("size", "size_b") - 1e-9)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_pairs(nodes: DataFrame, similarity: float, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b), a < b: pairs that connect the nodes of equal and of linked fingerprints, if their sizes allow the similarity.

    nodes: node, size, fp.  One node stands for its fingerprint; links are those of operator 10.
    """
    first = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x"), F.count("*").alias("n")), "prints")
    links = near_links(first.select("fp"), bucket_limit=bucket_limit)
    far = links.join(first.select(F.col("fp").alias("a"), F.col("x").alias("p")), "a").join(first.select(F.col("fp").alias("b"), F.col("x").alias("q")), "b").select("p", "q")
    same = nodes.join(first.filter("n > 1").select("fp", F.col("x").alias("p")), "fp").filter("node <> p.node").select("p", F.struct("node", "size").alias("q"))
    met = far.unionByName(same).filter(F.least("p.size", "q.size") >= similarity * F.greatest("p.size", "q.size") - 1e-9)
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))


def _labels(links: DataFrame, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """(node, label): the smallest node that a few links lead to; not always the smallest of the component."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label"))
    for _ in range(rounds - 1):
        label = materialise(label, "labels")
        far = both.join(label.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        label = label.join(far, "u").select("u", F.least("label", "m").alias("label"))
    return label.select(F.col("u").alias("node"), "label")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(both >= similarity * (F.size("set_a") + F.size("set_b") - both) - 1e-9).select("a", "b")


def _differences(crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """crowds with what differs between each set and its crowd's leading set, and whether the two are similar.

    crowds: crowd (the leading node), node, size, label; more: lead (the leading set's size), items, d (their number), alike.
    """
    both = crowds.join(sets.select("node", F.col("shingles").alias("own")), "node").join(sets.select(F.col("node").alias("crowd"), F.col("shingles").alias("of")), "crowd")
    found = both.select(*crowds.columns, F.size("of").cast("long").alias("lead"), F.concat(F.array_except("own", "of"), F.array_except("of", "own")).alias("items"))
    found = found.withColumn("d", F.size("items").cast("long"))
    shared = (F.col("size") + F.col("lead") - F.col("d")) / 2
    return found.withColumn("alike", shared >= similarity * (F.col("size") + F.col("lead") - shared) - 1e-9)


def _crowd_pairs(differences: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: distinct pairs of a crowd that may be similar; all that are, but for those that the leading set connects.

    Sets of sizes s and t are similar only if they differ in (s + t) * (1 - similarity) / (1 + similarity) shingles at
    most.  With d and e differences from the leading set they share (d + e - that) / 2 of these or more.  If this is
    not above zero, both are similar to the leading set.  Else they share one among the first d + 1 - that
    of the one's and e + 1 - that of the other's, in any common order; here the rarest come first.  Sets meet under
    an item and both classes of their numbers of differences, as few items are needed of unlike numbers.
    """
    own = differences.withColumn("label", F.when(F.col("alike"), F.col("crowd")).otherwise(F.col("label")))
    own = own.withColumn("most", F.floor(F.col("size") * (1 / similarity - 1) + 1e-6)).withColumn("width", F.greatest(F.lit(1), F.floor(F.col("lead") / CLASSES)))
    items = own.select("crowd", "node", "size", "label", "d", "most", "width", F.explode("items").alias("item"))
    items = items.withColumn("n", F.count("*").over(Window.partitionBy("crowd", "item")))
    items = items.withColumn("at", F.row_number().over(Window.partitionBy("crowd", "node").orderBy("n", "item"))).filter("at <= most + 1")
    items = materialise(items, "items")  # met with itself, from here on
    least = F.greatest(F.col("d") - F.col("most"), F.lit(0))
    dealt = items.withColumn("class", F.floor(F.col("d") / F.col("width"))).withColumn("other", F.explode(F.sequence(F.floor(least / F.col("width")), F.floor((F.col("d") + F.col("most")) / F.col("width")))))
    dealt = dealt.filter(F.col("at") <= F.floor((F.col("d") - F.greatest(F.col("other") * F.col("width"), least) + F.col("most")) / 2) + 1)
    right = dealt.select("crowd", "item", F.col("other").alias("class"), F.col("class").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "label", "d", "at")))
    met = dealt.filter("label <> crowd").select("crowd", "item", "class", "other", "node", "size", "label", "d", "at").join(right, ["crowd", "item", "class", "other"])
    met = met.filter("label <> label_b").filter(F.least("size", "size_b") >= similarity * F.greatest("size", "size_b") - 1e-9)
    apart = (F.col("size") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    met = met.filter(F.col("at") <= (F.col("d") - F.col("d_b") + apart) / 2 + 1).filter(F.col("at_b") <= (F.col("d_b") - F.col("d") + apart) / 2 + 1)
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def similar_components(signed: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, bucket_limit: int = BUCKET_LIMIT, also: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that similar pairs under a common key link.

    signed: key, node, size of the sets that share a key with another; sets: node, shingles; also: further pairs a, b to compare.
    """
    own = signed.withColumn("label", F.col("node"))
    pivot = lambda turn: F.min_by(F.struct("node", "size", "label"), F.xxhash64("node", F.lit(turn)))
    chosen = own.groupBy("key").agg(pivot(0).alias("p"), pivot(1).alias("q"), F.count("*").alias("n"))
    pivots = chosen.select("key", F.explode(F.array("p", F.when(F.col("n") > bucket_limit, F.col("q")))).alias("x")).filter("x is not null").select("key", "x.*")
    first = _pairs(pivots, own, similarity)
    tested = materialise(first if also is None else first.unionByName(also).distinct(), "pairs")
    links = materialise(_alike(tested, sets, similarity), "alike")

    own = materialise(signed.join(_labels(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    found = own.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("lead"), F.count("*").alias("labels"))
    rest = materialise(own.join(found.filter("labels > 1").drop("labels"), "key"), "rest")
    # Each set's leading label is that of its fullest key.
    led = rest.groupBy("node").agg(F.max("lead").alias("lead"), F.first("size").alias("size"), F.first("label").alias("label")).select(F.col("lead.label").alias("crowd"), "node", "size", "label")
    large = led.groupBy("crowd").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_limit).select("crowd")
    crowds = materialise(led.join(large, "crowd"), "crowds")
    differences = materialise(_differences(crowds, sets, similarity), "differences")
    near = differences.filter("alike AND node <> crowd").select(F.col("crowd").alias("a"), F.col("node").alias("b"))

    # Under the keys, sets of one label, and those of one crowd, need not meet: sets outside the largest such unit meet all others.
    unit = F.struct("crowd", F.when(F.col("crowd").isNull(), F.col("label")).alias("label"))
    rest = rest.drop("lead").join(crowds.select("node", "crowd"), "node", "left").withColumn("unit", F.xxhash64(unit))
    units = rest.groupBy("key", "unit").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("unit", F.struct("m", "unit")).alias("largest"), F.count("*").alias("units"))
    mixed = materialise(rest.join(units.filter("units > 1"), "key"), "rest")
    # Each table is a plan of its own, so that the driver need not hold the tasks of all at once.
    within = materialise(_crowd_pairs(differences, similarity), "crowd")
    pairs = _pairs(mixed.filter("unit <> largest"), mixed, similarity, "unit").unionByName(within).distinct()
    pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    return components(links.unionByName(near).unionByName(materialise(_alike(pairs, sets, similarity), "alike")))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, component): rows of docs that similar pairs link have the same component."""
    signed = materialise(signatures(docs, shingle_words), "signatures")
    nodes = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    several = materialise(keyed.join(shared, "key"), "shared")
    also = materialise(fingerprint_pairs(nodes.filter("size > 0").select("node", "size", "fp"), similarity, bucket_limit), "prints")
    wanted = several.select("node").unionByName(also.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    # A set that meets another is made again from a text that has it; a null doc_id finds no text by itself.
    ids = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id"))
    named = docs.select(F.col("doc_id").alias("_id"), "text")
    texts = named.join(ids.filter("_id is not null").select("_id").distinct(), "_id", "left_semi").unionByName(named.filter("_id is null"))
    sets = materialise(shingle_sets(texts, shingle_words).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    reached = materialise(similar_components(several, sets, similarity, bucket_limit, also), "reached")
    return signed.select("doc_id", "node").join(reached, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The row with the smallest doc_id of each group that similar pairs link, with all its columns.

    Texts with the same shingles (those without words, too) are similar.  Null and empty texts
    have no shingles.  Rows whose doc_id is null are all kept.  A doc_id that several rows have
    goes if any of them is linked to a smaller one.  Further columns are not looked at.  No rows
    give no rows.
    """
    goes = free_name(docs, "goes")
    of = materialise(similar_groups(docs, similarity, shingle_words, bucket_limit), "groups")
    least = of.groupBy("component").agg(F.min("doc_id").alias("least"))
    ids = of.join(least, "component").filter("least < doc_id").select(F.col("doc_id").alias(goes)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(goes), "left_anti")
