"""Test items inside documents, by size-partitioned MinHash containment search.

Texts are lower-cased (A-Z) and cut into words; an item is the set of its shingles of five
words (an item with fewer words is one shingle of all of them).  Items are partitioned by
size: class c holds items of 2**c to 2**(c + 1) - 1 shingles.  For each class a document is
seen through windows of 2**(c + 2) shingles that overlap by half, so that its size is within
a small factor of the item's, and containment of 0.8 means a Jaccard similarity of at least
0.19 to the windows that hold the shared shingles.  A document is a candidate if a window
and an item share one of 64 minima.  That misses a contaminated document with a probability
below 0.81 ** 64, or 2e-6, if all shared shingles are in one window, and about the same if
they are spread over several.  Candidates are verified by exact shingle containment in the
whole document.

The minima of a window are looked up where the document is read, in one pass over the documents:
the items come in blocks of a checked size, each of which is broadcast, and only matches leave
the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.scratch import materialise
from kithline.llm.shipping import ship
from kithline.llm.workers import sole
from kithline.llm.words import Words, parts

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
HASHES = 64
#: Bounds of what is broadcast at once.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Blocks that a worker keeps in memory.
HELD_BLOCKS = 4

_ODD = (np.random.default_rng(7).integers(1, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)


def _permuted(x: np.ndarray, j: int) -> np.ndarray:
    """The j-th bijection of 32-bit numbers."""
    y = x * _ODD[j]
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    y ^= y >> np.uint32(12)
    return y


def _cut(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i: i + n]) for i in range(len(words) - n + 1)}


def _hashed(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = words.window_hashes(hashes, n)
    return at, (h >> np.uint64(32)).astype(np.uint32)


class _Class:
    """Items of one shingle width and size, and their minima."""

    def __init__(self, level: int):
        self.level, self.items, self.minima = level, [], []

    def settle(self) -> None:
        self.values, self.owners, self.maybe = [], [], np.zeros((HASHES, 1 << 16), bool)
        own = np.array(self.items)
        for j in range(HASHES):
            column = np.array([m[j] for m in self.minima], np.uint32)
            order = np.argsort(column, kind="stable")
            self.values.append(column[order])
            self.owners.append(own[order])
            self.maybe[j, column & np.uint32(0xFFFF)] = True

    def found(self, j: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(window, items) that share the j-th minimum."""
        for i in np.flatnonzero(self.maybe[j][least & np.uint32(0xFFFF)]):
            lo, hi = np.searchsorted(self.values[j], least[i], "left"), np.searchsorted(self.values[j], least[i], "right")
            if hi > lo:
                yield int(i), self.owners[j][lo:hi]


class Items:
    """A block of items, ready for the search."""

    def __init__(self, rows: list[tuple[object, str | None]], shingle_words: int):
        self.ids, self.shingles = [], []
        self.classes: dict[int, dict[int, _Class]] = {}
        for item_id, text in rows:
            words = _cut(text)
            if not words:
                continue
            width = min(shingle_words, len(words))
            joined = b" ".join(words)
            w = Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
            _, x = _hashed(w, w.hashes(), width)
            own = _shingles(words, width)
            level = len(own).bit_length() - 1
            into = self.classes.setdefault(width, {}).setdefault(level, _Class(level))
            into.items.append(len(self.ids))
            into.minima.append([int(_permuted(x, j).min()) for j in range(HASHES)])
            self.ids.append(item_id)
            self.shingles.append(sorted(own))
        for of_width in self.classes.values():
            for c in of_width.values():
                c.settle()

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item)"""
        out: set[tuple[int, int]] = set()
        hashes = words.hashes()
        for width, levels in self.classes.items():
            at, x = _hashed(words, hashes, width)
            if not len(x):
                continue
            doc = words.doc[at]
            base = 2 << min(levels)
            n = -(-len(x) // base)
            # Column i holds the shingles of the i-th stretch of base; the last is filled up by repeating one.
            table = np.ascontiguousarray(np.pad(x, (0, n * base - len(x)), "edge").reshape(n, base).T)
            windows: set[tuple[int, int, int]] = set()
            for j in range(HASHES):
                least, level = np.minimum.reduce(_permuted(table, j), axis=0), min(levels)
                while True:
                    if level in levels:
                        both = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                        windows.update((level, i, int(k)) for i, items in levels[level].found(j, both) for k in items)
                    if level >= max(levels):
                        break
                    if len(least) % 2:
                        least = np.append(least, least[-1])
                    least, level = np.minimum(least[::2], least[1::2]), level + 1
            for level, i, item in windows:
                step = 2 << level
                lo, hi = i * step, min((i + 2) * step, len(x)) - 1
                out.update((d, item) for d in range(int(doc[lo]), int(doc[hi]) + 1))
        return out

    def matches(self, column: pa.Array, containment: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared shingles, shingles of the item)"""
        for lo, _, data, bounds in parts(column):
            by_doc: dict[int, list[int]] = {}
            for d, item in self.candidates(Words(data, bounds, lower=True)):
                by_doc.setdefault(d, []).append(item)
            for d in sorted(by_doc):
                text = b" " + b" ".join(data[bounds[d]: bounds[d + 1]].tobytes().lower().split()) + b" "
                for item in sorted(by_doc[d]):
                    own = self.shingles[item]
                    shared = sum(b" " + s + b" " in text for s in own)
                    if shared >= containment * len(own) - 1e-9:
                        yield lo + d, item, shared, len(own)


def _blocks(items: DataFrame, shingle_words: int) -> list[Broadcast]:
    """The items in broadcast blocks of a checked size; each is collected on its own."""
    spark = items.sparkSession
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = 1 if n <= BLOCK_ITEMS and size <= BLOCK_BYTES else 2 * math.ceil(max(n / BLOCK_ITEMS, size / BLOCK_BYTES))
    keyed = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    if blocks > 1:  # written in the order of blocks, so that each is read from its own part
        keyed = materialise(keyed.repartitionByRange("block").sortWithinPartitions("block"), "items")
    return [spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in keyed.filter(F.col("block") == b).collect()], shingle_words)) for b in range(blocks)]


def _matches(blocks: list[Broadcast], column: pa.Array, containment: float) -> Iterator[tuple[Items, tuple[int, int, int, int]]]:
    """The matches of all blocks; a worker holds the first few and reads the others again, one after another."""
    for i, block in enumerate(blocks):
        own = block.value
        for match in own.matches(column, containment):
            yield own, match
        if i >= HELD_BLOCKS:
            block.__dict__.pop("_value", None)


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles), a row for each document and item it contains.

    docs needs doc_id and text, items needs item_id and text.  A document contains an item if
    it has at least the share containment of the item's distinct shingles.  Null and empty
    texts contain nothing; items without words are contained in nothing.  Repeated rows on
    either side give repeated matches.  Without documents or items there are no rows.
    """
    ship(docs.sparkSession)
    ids, item_ids = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {ids.simpleString()}, item_id {item_ids.simpleString()}, n_shared long, n_shingles long"
    blocks = _blocks(items, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found = [(own.ids[f[1]], *f) for own, f in _matches(blocks, batch.column(1), containment)]
            rows = pa.array([f[1] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([f[0] for f in found], to_arrow_type(item_ids)), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                ["doc_id", "item_id", "n_shared", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(sole("decontaminate", run), schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs that contain none of the items, with all their columns; nothing is shuffled.

    docs needs text; see contaminated.  Rows with null or empty texts stay, repeated rows stay or
    go together, and columns of any other name are passed on.  No rows give no rows.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    blocks = _blocks(items, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for _, f in _matches(blocks, batch.column(at), containment)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(sole("decontaminate", run), docs.schema)
