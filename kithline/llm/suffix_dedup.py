"""Repeated passages, found by a sparse suffix array.

Of the suffixes that begin in a stretch of 31 consecutive positions only the one at the
minimiser stays: the leftmost position whose 20 words have the smallest hash.  The choice
depends on the content alone, so two equal windows of 50 words retain the suffix at the same
offset.  About one suffix in sixteen is retained.

The retained suffixes are put in order of their first 20 words, taken as one symbol (its
64-bit hash), and of the documents behind it: range partitions, sorted, so that no group of
equal beginnings, however large, has to be in one task.  Neighbours in this order are
compared.  A suffix with an equal beginning next to it in another document is a match, and is
extended word by word: to the left as far as the stretch goes, to the right to the end of
the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kithline.llm.passages import Anchors, by_key, remove_repeats
from kithline.llm.scratch import materialise
from kithline.llm.words import Piece

WINDOW = 50
STRETCH = 31


def minimiser_anchors(window: int = WINDOW, stretch: int = STRETCH) -> Anchors:
    if stretch > window:
        raise ValueError("the stretch must not exceed the window")

    def anchors(piece: Piece, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = piece.words
        at, key = words.window_hashes(hashes, window - stretch + 1)
        if len(at) < stretch:
            return at[:0], key[:0]
        doc = words.doc[at]
        inside = np.flatnonzero(doc[stretch - 1:] == doc[: len(doc) - stretch + 1])
        least, where = key.copy(), np.arange(len(key))
        # After the loop, least[i] is the smallest of span keys from i, where[i] its leftmost place.
        span = 1
        while span < stretch:
            step = min(span, stretch - span)
            smaller = least[step:] < least[:-step]
            least[:-step] = np.where(smaller, least[step:], least[:-step])
            where[:-step] = np.where(smaller, where[step:], where[:-step])
            span += step
        chosen = np.unique(where[inside])
        return at[chosen], key[chosen]

    return anchors


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos) of sorted suffixes whose run of equal beginnings has several documents.

    The first and the last run of a batch may go on beyond it; they count as matches, which
    the extension then settles.
    """
    for batch in batches:
        k, salt, doc = (batch.column(i).to_numpy() for i in range(3))
        known = batch.column(4).to_numpy(zero_copy_only=False)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        end = np.append(begin[1:], len(k)) - 1
        matches = doc[begin] != doc[end]
        matches[[0, -1]] = True
        hit = pa.array(known | matches[np.cumsum(new) - 1])
        yield pa.RecordBatch.from_arrays([batch.column(2).filter(hit), batch.column(3).filter(hit)], ["doc_id", "pos"])


def by_order(rows: DataFrame) -> DataFrame:
    """The suffixes that a neighbour matches, and the whole copies of smaller documents."""
    # Written once, as the bounds of the ranges are found by a look at all rows.
    rows = materialise(rows, "suffixes")
    order = ["k", "salt", "doc_id"]
    suffixes = rows.filter("not copy").repartitionByRange(*order).sortWithinPartitions(*order)
    return suffixes.mapInArrow(_neighbours, "doc_id long, pos long").unionByName(by_key(rows.filter("copy")).select("doc_id", "pos"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept); see remove_repeats for rows and edge cases."""
    stretch = min(STRETCH, window)
    return remove_repeats(docs, minimiser_anchors(window, stretch), by_order, window, stretch - 1)
