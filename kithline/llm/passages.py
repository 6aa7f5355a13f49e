"""Removal of long word passages that also occur in an earlier document.

A word goes if some window of consecutive words covers it whose word sequence also starts in
a document with a smaller doc_id.  Two operators remove such passages: substring_dedup meets
anchors by their hash, suffix_dedup sorts suffixes and compares neighbours.  What they share
is here:

1. Anchors.  Each equal pair of windows has an anchor at the same offset, not more than
   `reach` words after the window's start.  The operator says which anchors repeat.
2. Extension.  To the left and to the right of those anchors every window is hashed.  Of equal
   windows the smallest doc_id is found; the windows of larger ones are marked.
3. The words that marked windows cover are dropped.

Windows count as equal if 128 bits of two independent hashes are (see words); their words are
not compared again, as that would send every window's text to every partner.

Whole copies of a word sequence are told by a row for each document, so their windows are
not hashed.  Anchors and windows that recur within a batch of documents are decided
there, and one row of each goes on, so a passage that a third of all documents have gives one
row for each batch to its key, not one for each document.  Long texts are read in pieces, so
the memory of a task is a small multiple of its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.shipping import ship
from kithline.llm.words import Piece, mix, parts, pieces, text_bytes, word_runs

#: Given a piece and its words' hashes: the first word of each anchor, and its hash.
Anchors = Callable[[Piece, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Given rows (k, salt, doc_id, pos, known, copy): those that repeat, of which doc_id and pos are read.
Repeats = Callable[[DataFrame], DataFrame]

ANCHOR_ROWS = "k long, salt long, doc_id long, pos long, known boolean, copy boolean"
WINDOW_ROWS = "a long, b long, doc_id long, seq long, pos long, n long, more array<long>, sure boolean"
#: Bytes of text whose anchors or windows are held at once.
HELD = 8 << 20

_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64), pa.int64())


def _cat(arrays: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _groups(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys and document, and in that order: the begin of each row's group, its smallest and its largest document."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order)) - 1
    of = np.cumsum(new) - 1
    d = doc[order]
    return order, (begin[of] if len(begin) else of), (d[begin][of] if len(begin) else d), (d[end][of] if len(begin) else d)


def _copy_code(sequence: np.ndarray) -> np.ndarray:
    """A negative number that stands for a word sequence where else a position stands."""
    return -1 - (sequence >> _U(2)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = HELD) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes of text; a longer text is alone."""
    for batch in batches:
        for lo, hi, _, _ in parts(batch.column(text), size):
            yield batch.slice(lo, hi - lo)


def _sequence(column: pa.Array, row: int) -> np.uint64:
    """The sequence hash of one text, read in pieces."""
    total, n = np.zeros(1, _U), 0
    for p in pieces(column.slice(row, 1), 0):
        total += p.words.sequence_sums(p.words.hashes(), p.base, p.seen)
        n += len(p.words.start)
    return mix(total + _U(n))[0]


def _anchor_rows(anchors: Anchors, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as in ANCHOR_ROWS.  known: another document of the batch has it too.  copy: the row stands for a whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums, size = np.zeros((2, len(ids)), _U), np.zeros(len(ids), np.int64)
            keys, rows, places = [], [], []
            for p in pieces(batch.column(1), window - 1):
                w = p.words
                h = w.hashes()
                at, key = anchors(p, h)
                keys.append(key)
                rows.append(p.row(at))
                places.append(p.place(at))
                np.add.at(sums[0], p.rows, w.sequence_sums(h, p.base, p.seen))
                np.add.at(sums[1], p.rows, w.sequence_sums(w.hashes(1), p.base, p.seen, 1))
                np.add.at(size, p.rows, np.diff(w.first) - p.seen)
            one, two = mix(sums[0] + size.astype(_U)), mix(sums[1] + size.astype(_U))
            long = np.flatnonzero(size >= window)
            # Whole copies: the smallest of the batch goes on to meet those of other batches.
            order, _, least, _ = _groups(ids[long], one[long], two[long])
            of = long[order]
            again = ids[of] > least
            is_copy = np.zeros(len(ids), bool)
            is_copy[of[again]] = True
            salt = np.where(again, mix(one[of] ^ ids[of].astype(_U)), two[of])
            out = [(one[of], salt, ids[of], _copy_code(one[of]), again, np.ones(len(of), bool))]
            key, row, pos = _cat(keys, _U), _cat(rows), _cat(places)
            use = ~is_copy[row]
            key, row, pos = key[use], row[use], pos[use]
            order, begin, least, most = _groups(ids[row], key)
            key, row, pos = key[order], row[order], pos[order]
            known = least != most
            rest = known & (np.arange(len(order)) != begin)
            salt = np.where(rest, mix(ids[row].astype(_U) ^ mix(pos.astype(_U))) | _U(1), _U(0))
            out.append((key, salt, ids[row], pos, known, np.zeros(len(key), bool)))
            k, s, d, p, f, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([_signed(k), _signed(s), pa.array(d), pa.array(p), pa.array(f), pa.array(c)], ["k", "salt", "doc_id", "pos", "known", "copy"])

    return run


def _list_of(column: pa.Array, i: int) -> np.ndarray:
    return column.slice(i, 1).flatten().to_numpy(zero_copy_only=False)


def _settled(found: list[tuple[np.ndarray, ...]], marked: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Window rows of (a, b, doc_id, seq, pos) in the texts' order, and of whole copies (doc_id, seq, windows)."""
    a, b, s = (_cat([x[i] for x in found], _U) for i in (0, 1, 3))
    d, p = (_cat([x[i] for x in found]) for i in (2, 4))
    # Equal windows one after another, as in a run of one word, are one row.
    new = np.ones(len(a), bool)
    if len(a):
        new[1:] = (p[1:] != p[:-1] + 1) | np.any([x[1:] != x[:-1] for x in (a, b, d, s)], axis=0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(a)))
    a, b, d, s, p = (x[at] for x in (a, b, d, s, p))
    order, _, least, _ = _groups(d, a, b)
    known = d[order] > least
    go = order[~known]
    # A window that recurs in one document is one row, with its further places and their numbers in a list.
    new = np.ones(len(go), bool)
    if len(go):
        new[1:] = np.any([x[go[1:]] != x[go[:-1]] for x in (a, b, d, s)], axis=0)
    first = np.flatnonzero(new)
    spare = np.flatnonzero(~new)
    further = np.stack([p[go[spare]], n[go[spare]]], 1).ravel()
    lists = 2 * (np.diff(np.append(first, len(go))) - 1)
    go = go[first]
    # Windows that are decided here, as runs of one document.
    here = order[known]
    here = here[np.lexsort((p[here], s[here], d[here]))]
    new = np.ones(len(here), bool)
    if len(here):
        x, y = here[1:], here[:-1]
        new[1:] = (d[x] != d[y]) | (s[x] != s[y]) | (p[x] != p[y] + n[y])
    begin = np.flatnonzero(new)
    mine = here[begin]
    length = np.add.reduceat(n[here], begin) if len(begin) else begin
    md = np.concatenate([d[mine], np.array([m[0] for m in marked], np.int64)])
    ms = np.concatenate([s[mine], np.array([m[1] for m in marked], _U)])
    mp = np.concatenate([p[mine], np.zeros(len(marked), np.int64)])
    mn = np.concatenate([length, np.array([m[2] for m in marked], np.int64)])
    spread = mix(ms ^ md.astype(_U))
    ends = np.cumsum(np.concatenate([[0], lists, np.zeros(len(md), np.int64)])).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(ends), pa.array(further, pa.int64()), mask=pa.array(np.diff(ends) == 0))
    return pa.RecordBatch.from_arrays(
        [_signed(np.concatenate([a[go], spread])), _signed(np.concatenate([b[go], mix(mp.astype(_U) ^ spread)])), pa.array(np.concatenate([d[go], md])), _signed(np.concatenate([s[go], ms])),
         pa.array(np.concatenate([p[go], mp])), pa.array(np.concatenate([n[go], mn])), more, pa.array(np.arange(len(go) + len(md)) >= len(go))],
        ["a", "b", "doc_id", "seq", "pos", "n", "more", "sure"])


def _window_rows(window: int, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as in WINDOW_ROWS: n windows from pos on, and more of them, as positions and numbers in turn.

    sure: they are marked; else all have the hash (a, b).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy().astype(np.int64)
            texts, flags = batch.column(1), batch.column(2)
            found, marked, held = [], [], 0
            whole: dict[int, np.uint64] = {}
            skipped: set[int] = set()
            own: dict[int, np.ndarray] = {}
            for p in pieces(texts, window - 1):
                w = p.words
                one, two = w.hashes(), w.hashes(1)
                alone = len(p.rows) == 1
                if alone and int(p.rows[0]) not in whole:
                    whole[int(p.rows[0])] = _sequence(texts, int(p.rows[0]))
                seq = np.array([whole[int(p.rows[0])]]) if alone else w.sequence_hashes(one)
                wanted = np.zeros(len(one) + 1, np.int32)
                for i, row in enumerate(map(int, p.rows)):
                    first, to, base = int(w.first[i]), int(w.first[i + 1]), int(p.base[i])
                    if row in skipped or to - first < window:
                        continue
                    if row not in own:
                        at = own[row] = np.sort(_list_of(flags, row))
                        if (at == _copy_code(seq[i: i + 1])[0]).any():
                            skipped.add(row)
                            marked.append((ids[row], seq[i], row))
                            continue
                    at = own[row]
                    at = at[np.searchsorted(at, base): np.searchsorted(at, base + to - first + reach)] - base
                    np.add.at(wanted, first + np.maximum(at - reach, 0), 1)
                    np.add.at(wanted, first + np.minimum(at + 1, to - first), -1)
                start, a = w.window_hashes(one, window)
                _, b = w.window_hashes(two, window, 1)
                use = np.cumsum(wanted)[start] > 0
                start, a, b = start[use], a[use], b[use]
                found.append((a, b, ids[p.row(start)], seq[w.doc[start]], p.place(start)))
                held += len(w.data)
                if held >= HELD:
                    yield _settled(found, [])
                    found, held = [], 0
            size = {row: sum(len(r) for r in word_runs(texts[row].as_py().encode())) for _, _, row in marked}
            yield _settled(found, [(i, q, size[row] - window + 1) for i, q, row in marked])

    return run


def _without(text: bytes, marks: pa.StructArray, window: int, sequence: int) -> tuple[int, list[bytes]]:
    """(number of words, kept words in runs); marks of another text with the same doc_id are passed over."""
    marks = marks.filter(pa.array(marks.field("seq").to_numpy(zero_copy_only=False) == sequence))
    more = marks.field("more").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    pos = np.concatenate([marks.field("pos").to_numpy(zero_copy_only=False), more[:, 0]])
    to = pos + np.concatenate([marks.field("n").to_numpy(zero_copy_only=False), more[:, 1]]) + window - 1
    steps, by = np.unique(np.concatenate([pos, to]), return_inverse=True)
    depth = np.cumsum(np.bincount(by, np.repeat([1, -1], len(pos)), len(steps)))
    n, kept = 0, []
    for words in word_runs(text):
        at = np.searchsorted(steps, np.arange(n, n + len(words)), "right") - 1
        stays = (at < 0) | (depth[at] == 0)
        n += len(words)
        if stays.any():
            kept.append(b" ".join(compress(words, stays)))
    return n, kept


def _kept_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            total, gone, kept = [], [], []
            data, bounds = text_bytes(batch.column(1))
            marks = batch.column(2)
            for i in range(batch.num_rows):
                text = data[bounds[i]: bounds[i + 1]].tobytes()
                if marks[i].is_valid:
                    n, runs = _without(text, marks.slice(i, 1).flatten(), window, int(_sequence(batch.column(1), i).view(np.int64)))
                else:
                    runs, n = [], 0
                    for words in word_runs(text):
                        n += len(words)
                        runs += [b" ".join(words)] if words else []
                stays = b" ".join(runs)
                total.append(n)
                gone.append(n - (stays.count(b" ") + 1 if stays else 0))
                kept.append(stays)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def by_key(rows: DataFrame) -> DataFrame:
    """The anchors, and the whole copies of smaller documents, that repeat: rows of a key are met by hash."""
    of = Window.partitionBy("k", "salt")
    rows = rows.withColumn("least", F.min("doc_id").over(of)).withColumn("most", F.max("doc_id").over(of))
    return rows.filter(F.col("known") | F.when(F.col("copy"), F.col("doc_id") > F.col("least")).otherwise(F.col("least") < F.col("most")))


def remove_repeats(docs: DataFrame, anchors: Anchors, repeats: Repeats, window: int, reach: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of docs; kept: the words that stay, joined by one space.

    docs needs doc_id, a whole number, and text.  A null or empty text has no words.  A row whose
    doc_id is null loses nothing and takes nothing from others.  Rows that repeat a doc_id take
    nothing from each other.  Shorter texts than a window stay whole.  No rows give no rows.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number: passages are ordered by it")
    ship(docs.sparkSession)
    # Both joins read the same rows and columns, so that they share one shuffle of the texts.
    # A cast would be left in one of the two plans only, so it is made where it is needed.
    every = docs.select("doc_id", "text")
    if dict(every.dtypes)["doc_id"] != "bigint":
        every = every.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts, without = every.filter("doc_id is not null"), every.filter("doc_id is null")
    found = repeats(texts.mapInArrow(_anchor_rows(anchors, window), ANCHOR_ROWS))
    flags = found.groupBy("doc_id").agg(F.collect_list("pos").alias("flags"))
    windows = texts.join(flags, "doc_id").mapInArrow(_window_rows(window, reach), WINDOW_ROWS)
    windows = windows.withColumn("least", F.min("doc_id").over(Window.partitionBy("a", "b"))).filter("sure or doc_id > least")
    marks = windows.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "pos", "n", "more")).alias("marks"))
    marked = texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks")
    none = without.select("doc_id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    return marked.unionByName(none).mapInArrow(_kept_rows(window), "doc_id long, n_words long, n_removed long, kept string")
