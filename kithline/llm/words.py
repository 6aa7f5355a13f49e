"""Words, word hashes and window hashes of many texts at once, with numpy.

A word is a run of bytes other than space and 0x09 to 0x0D.  bytes.split() without an
argument splits at exactly these.

A word's hash is the sum, over its bytes, of a pseudo-random 64-bit number for the byte and
its place in the word (tabulation hashing), mixed with the length.  A window's hash joins the
hashes of its halves and mixes at every step.  Neither is a polynomial, so no words or
sequences of a regular form collide; two of them, from different numbers, are 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Begins of two independent series of pseudo-random numbers, and odd factors of two joins.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Places in a word whose numbers are kept in a table; those of later places are computed.
_PLACES = 32
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _numbers(x: np.ndarray, which: int) -> np.ndarray:
    """Pseudo-random numbers of non-negative numbers."""
    return mix(mix(x.astype(_U) + _U(_SEEDS[which])) ^ _U(_FACTORS[which]))


def _table(which: int) -> np.ndarray:
    if which not in _TABLES:
        _TABLES[which] = _numbers(np.arange(_PLACES * 256), which)
    return _TABLES[which]


def _joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    return mix(a * _U(_FACTORS[which]) + b)


class Words:
    """The words of consecutive texts: word k is data[start[k]:end[k]].

    first[d] to first[d + 1] are the words of text d.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        """data: bytes of all texts; bounds: where each text begins, and the end."""
        self.data = _LOWER[data] if lower else data
        inner = ~_IS_SPACE[self.data]
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        ends = inner.copy()
        ends[:-1] &= ~inner[1:]
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = inner[cut]
        ends[cut - 1] = inner[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self._inner, self._cells = inner, None

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a word, place * 256 + byte; and where each word begins among these."""
        if self._cells is None:
            length = self.end - self.start
            begin = np.cumsum(length) - length
            place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
            place <<= 8
            place |= self.data[self._inner]
            self._cells = place, begin
        return self._cells

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, _U)
        cell, begin = self._places()
        if int((self.end - self.start).max()) <= _PLACES:
            number = _table(which)[cell]
        else:
            number = _table(which)[np.minimum(cell, _PLACES * 256 - 1)]
            late = np.flatnonzero(cell >= _PLACES * 256)
            number[late] = _numbers(cell[late], which)
        return mix(np.add.reduceat(number, begin) + (self.end - self.start).astype(_U))

    def window_hashes(self, words: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of each n consecutive words of one text: the first word's number, and the hash."""
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        count = len(words) - n + 1
        whole, done, power, size = None, 0, words, 1
        while True:  # power: hashes of size words; whole: of the last `done` words of a window
            if n & size:
                at = n - done - size
                own = power[at: at + count]
                whole = own if whole is None else _joined(own, whole, which)
                done += size
            if done == n:
                break
            power, size = _joined(power[:-size], power[size:], which), 2 * size
        at = np.flatnonzero(self.doc[n - 1:] == self.doc[:count])
        # The number of words tells windows of different sizes apart.
        return at, mix(whole[at] + _U(n))

    def sequence_sums(self, words: np.ndarray, base: np.ndarray | None = None, seen: np.ndarray | None = None, which: int = 0) -> np.ndarray:
        """Of each text, the sum of its words' numbers by place; see sequence_hashes.

        base: the place of each text's first word, where texts are parts of longer ones.
        seen: how many words at the begin of each text are left out.
        """
        if not len(words):
            return np.zeros(len(self.first) - 1, _U)
        place = np.arange(len(words)) - self.first[self.doc]
        fresh = None if seen is None else place >= seen[self.doc]
        if base is not None:
            place = place + base[self.doc]
        number = mix(words ^ _numbers(place, which))
        if fresh is not None:
            number = np.where(fresh, number, _U(0))
        total = np.zeros(len(words) + 1, _U)
        np.cumsum(number, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def sequence_hashes(self, words: np.ndarray, which: int = 0) -> np.ndarray:
        """Of the whole word sequence of each text."""
        return mix(self.sequence_sums(words, which=which) + np.diff(self.first).astype(_U))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]: bounds[-1]], bounds - bounds[0]


def parts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of rows with about size bytes, so that arrays stay in the cache.

    A longer text is a run of its own.
    """
    data, bounds = text_bytes(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo]
        lo = hi


class Piece(NamedTuple):
    """Words of whole texts, or of a part of one text."""

    words: Words
    #: Of each text in it: its row, the place of its first word, and how many of its words the piece before has, too.
    rows: np.ndarray
    base: np.ndarray
    seen: np.ndarray
    #: Where the piece begins in the column's bytes.
    offset: int

    def place(self, word: np.ndarray) -> np.ndarray:
        """The places of words in their texts."""
        doc = self.words.doc[word]
        return word - self.words.first[doc] + self.base[doc]

    def row(self, word: np.ndarray) -> np.ndarray:
        return self.rows[self.words.doc[word]]


def pieces(column: pa.Array, overlap: int, size: int = 1 << 20, lower: bool = False) -> Iterator[Piece]:
    """The words of a column in pieces of about size bytes.

    A longer text comes in several pieces; each repeats the last `overlap` words of the one
    before, so every overlap + 1 consecutive words are together in exactly one of them.
    """
    offset = 0
    for lo, hi, data, bounds in parts(column, size):
        begin, offset = offset, offset + len(data)
        if hi - lo > 1 or len(data) <= 2 * size:
            none = np.zeros(hi - lo, np.int64)
            yield Piece(Words(data, bounds, lower), np.arange(lo, hi), none, none, begin)
            continue
        at, base, seen, step = 0, 0, 0, size
        while True:
            to = min(at + step, len(data))
            while to < len(data) and not _IS_SPACE[data[to]]:
                to += 1
            words = Words(data[at:to], np.array([0, to - at]), lower)
            n = len(words.start)
            if to < len(data) and n <= 2 * overlap:  # very long words
                step *= 2
                continue
            yield Piece(words, np.array([lo]), np.array([base]), np.array([seen]), begin + at)
            if to == len(data):
                break
            seen, step = overlap, size
            at, base = at + (int(words.start[n - overlap]) if overlap else to - at), base + n - overlap


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of text in runs from about size bytes each, so that a very long text needs no list of all its words."""
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        while to < len(text) and not _IS_SPACE[text[to]]:
            to += 1
        yield text[at:to].split()
        at = to
