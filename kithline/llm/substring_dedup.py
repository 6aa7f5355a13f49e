"""Repeated passages, found by difference-cover anchors.

A window of 20 words is hashed only where its position modulo 31 is in a difference cover.
For any two residues there is a shift below 31 that takes both into the cover, so two
equal windows of 50 words share an anchor at the same offset, at most 30 words after their
start.  The anchors are a sixth of all positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kithline.llm.passages import Anchors, by_key, remove_repeats
from kithline.llm.words import Piece

WINDOW = 50
#: A perfect difference set: each residue but 0 is the difference of one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


def cover_anchors(window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> Anchors:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    if period > window:
        raise ValueError("the period must not exceed the window")
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def anchors(piece: Piece, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, key = piece.words.window_hashes(hashes, window - period + 1)
        use = chosen[piece.place(at) % period]
        return at[use], key[use]

    return anchors


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept); see remove_repeats for rows and edge cases."""
    period, cover = (PERIOD, COVER) if window >= PERIOD else (1, (0,))
    return remove_repeats(docs, cover_anchors(window, period, cover), by_key, window, period - 1)
