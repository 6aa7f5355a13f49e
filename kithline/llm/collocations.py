"""Collocations of two to four words, from upper bounds of a sketch and exact counts by automata.

A phrase is counted in a cell of a sketch by its hash; cells only ever count too much.  Tasks send
their cells in packed blocks, a bucket of the hash's first bits each, and a bucket's task adds them.
Phrases whose cell reaches the least count are candidates.  Longer phrases are sketched in a second
pass, where all their pairs of words are candidates.  Which cells passed goes to the workers as a
bitmap of bounded size; a bitmap too small for its cells lets more phrases pass and loses none.

In the third pass each shard of text compiles the candidates that occur in it into automata, with
a space before and behind each phrase and each word of the text, scans its text with them, and hands
on its counts, packed by buckets of the phrases' hashes.  A bucket's task adds them.  The sums are
exact, and the thresholds hold on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.scratch import materialise
from kithline.llm.shipping import ship
from kithline.llm.skew import join_groups
from kithline.llm.words import mix

LEAST, TOP, LONGEST = 30, 2000, 4
#: A shard is about so much text of one language, and an automaton has so many phrases at most.
SHARD_BYTES, AUTOMATON_PHRASES = 8 << 20, 200_000
#: The bitmap has so many bits for each cell that passed, and 2 to this power at most (64 MB).
BITS_PER_CELL, LARGEST_BITMAP = 64, 29
#: Ranks within a language are first taken in so many parts of it.
PARTS = 64

_U = np.uint64
#: Stands between pieces; no UTF-8 text has this byte.
_CUT = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _CUT * 10)


class _Numbers(dict):
    """Numbers of words, in the order in which they come; 0 is the cut between pieces."""

    def __init__(self):
        super().__init__({_CUT: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Texts of one language: its words by number, the numbers in order, and which piece each is in."""

    def __init__(self, lang: str):
        self.lang, self.number, self.bytes = lang, _Numbers(), 0
        self.texts: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        words = data.replace(_CUT, b" \xff ").split()
        self.texts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.bytes += len(data)

    def close(self) -> None:
        cut = np.zeros(1, np.int32)
        every = np.concatenate([x for t in self.texts for x in (t, cut)])
        kept = every != 0
        self.words = list(self.number)
        self.all, self.piece = every[kept], np.cumsum(~kept, dtype=np.int32)[kept]
        salt = xxhash.xxh64_intdigest(self.lang.encode(), 1)
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], _U) ^ _U(salt)
        self._cells = {1: mix(own)[self.all]}

    def cells(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on."""
        if n not in self._cells:
            first, word = self.cells(n - 1), self._cells[1][n - 1:]
            self._cells[n] = mix(first[: len(word)] * _U(0x9E3779B97F4A7C15) + word * _U(2 * n + 1))
        return self._cells[n]

    def inside(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        end = self.piece[n - 1:]
        return self.piece[: len(end)] == end

    def text(self) -> Iterator[str]:
        """Each text with a space around every word, and a line end between pieces."""
        words = [b"\n", *self.words[1:]]
        for ids in self.texts:
            yield (b" " + b" ".join([words[i] for i in ids.tolist()]) + b" ").decode()


def _parts(data: bytes, size: int) -> Iterator[bytes]:
    """data cut between pieces into parts of about size bytes; a piece stays whole."""
    begin = 0
    while len(data) - begin > size:
        end = data.find(_CUT, begin + size)
        if end < 0:
            break
        yield data[begin:end]
        begin = end + 1
    yield data[begin:] if begin else data


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """A text is cut between pieces where a shard is full; only a piece larger than a shard makes it larger."""
    held: dict[str, Shard] = {}

    def closed(lang: str) -> Shard:
        own = held.pop(lang)
        own.close()
        return own

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lang = "und" if lang is None else lang
            data = (text.as_py() or "").encode().translate(_TABLE)
            for part in _parts(data, size):
                if lang not in held:
                    held[lang] = Shard(lang)
                held[lang].add(part)
                if held[lang].bytes >= size:
                    yield closed(lang)
            # Many small languages together hold no more than two shards' text.
            if sum(s.bytes for s in held.values()) >= 2 * size:
                yield closed(max(held, key=lambda k: held[k].bytes))
    for lang in list(held):
        yield closed(lang)


class Passed:
    """A bitmap of the cells that passed."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.power = bits, power

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        at = cells >> _U(64 - self.power)
        return (self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _sketch(docs: DataFrame, cells: Callable[[Shard], list[np.ndarray]], least: int, shard_bytes: int, name: str) -> tuple[DataFrame, int]:
    """(bucket, hot, n): the cells of each bucket that count least or more; and the bucket's bits."""
    bits = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2).bit_length()
    kind = np.dtype("u1") if least < 256 else np.dtype("<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            found, n = np.unique(np.concatenate(cells(shard)) >> _U(32 - bits), return_counts=True)
            cut = np.searchsorted(found, np.arange((1 << bits) + 1, dtype=_U) << _U(32))
            low, n = found.astype("<u4"), np.minimum(n, least).astype(kind)  # what a task counts beyond least changes nothing
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([low[cut[b]: cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([n[cut[b]: cut[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "cells", "counts"])

    def add(table: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(table["cells"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), kind)
        order = np.argsort(low, kind="stable")
        low = low[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        hot = low[first][np.add.reduceat(n[order].astype(np.int64), first) >= least]
        return pa.table({"bucket": table["bucket"].combine_chunks()[:1], "hot": pa.array([hot.tobytes()], pa.binary()), "n": pa.array([len(hot)], pa.int64())})

    packed = docs.mapInArrow(count, "bucket long, cells binary, counts binary")
    return materialise(packed.groupBy("bucket").applyInArrow(add, "bucket long, hot binary, n long").filter("n > 0"), name), bits


def _passed(hot: DataFrame, bits: int, largest: int):
    """The bitmap of a sketch, broadcast: 2 ** largest bits at most."""
    n = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    power = min(max((n * BITS_PER_CELL).bit_length(), bits + 3), max(largest, bits + 3))
    own = power - bits  # a bucket is a slice of so many bits' power

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                flags = np.zeros(1 << own, np.uint8)
                flags[np.frombuffer(row.as_py(), "<u4") >> np.uint32(32 - own)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["bucket", "bits"])

    size = (1 << own) // 8
    whole = np.zeros(1 << power - 3, np.uint8)
    for row in hot.select("bucket", "hot").mapInArrow(draw, "bucket long, bits binary").toLocalIterator():
        whole[row.bucket * size: (row.bucket + 1) * size] = np.frombuffer(bytes(row.bits), np.uint8)
    return hot.sparkSession.sparkContext.broadcast((whole, power))


def _runs(shard: Shard, pairs: np.ndarray, n: int) -> np.ndarray:
    """Where n words of one piece begin all of whose pairs are candidates."""
    out = shard.inside(n)
    for k in range(n - 1):
        out = out & pairs[k: k + len(out)]
    return out


def _phrases(shard: Shard, short: Passed, long: Passed) -> Iterator[list[str]]:
    """The shard's candidates of one, two, three and four words, each once."""
    ids, words = shard.all, shard.words
    for i in np.unique(ids[short(shard.cells(1))]):
        yield [words[i]]
    pairs = shard.inside(2)
    pairs &= short(shard.cells(2))
    at = np.flatnonzero(pairs)
    _, first, number = np.unique(ids[at].astype(np.int64) << 32 | ids[at + 1], return_index=True, return_inverse=True)
    for i in at[first]:
        yield [words[j] for j in ids[i: i + 2]]
    pair = np.full(len(ids), -1, np.int64)
    pair[at] = number
    for n in (3, 4):
        at = np.flatnonzero(_runs(shard, pairs, n))
        at = at[long(shard.cells(n)[at])]
        _, first = np.unique(pair[at] << 32 | (ids[at + 2] if n == 3 else pair[at + 2]), return_index=True)
        for i in at[first]:
            yield [words[j] for j in ids[i: i + n]]


def _scan(shard: Shard, phrases: list[str]) -> np.ndarray:
    """How often each phrase stands in the shard, overlaps included."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    out, held = np.zeros(len(phrases), np.int64), []
    for piece in shard.text():
        held += [i for _, i in automaton.iter(piece)]
        if len(held) > 1_000_000:
            out += np.bincount(held, minlength=len(phrases))
            held = []
    return out + np.bincount(np.array(held, np.int64), minlength=len(phrases))


def _packed(lang: str, sizes: np.ndarray, phrases: list[bytes], f: np.ndarray, bits: int) -> pa.RecordBatch:
    """A shard's counts, a row for each bucket of the phrases' hashes."""
    bucket = np.array([xxhash.xxh64_intdigest(p) for p in phrases], _U) >> _U(64 - bits)
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    ends = pa.array([*first, len(order)], pa.int32())
    lists = [pa.array(sizes[order]), pa.array([phrases[i].decode() for i in order], pa.string()), pa.array(f[order])]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array([lang] * len(some), pa.string()), *(pa.ListArray.from_arrays(ends, x) for x in lists)], ["bucket", "lang", "sizes", "phrases", "counts"])


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, largest_bitmap: int = LARGEST_BITMAP) -> DataFrame:
    """(lang, size, phrase, f): phrases of one to four words that occur least times or more; size 0: all words.

    See collocations for what a word, a phrase and a lang are.
    """
    ship(docs.sparkSession)
    own = docs.select("lang", "text")
    hot, bits = _sketch(own, lambda s: [s.cells(1), s.cells(2)[s.inside(2)]], least, shard_bytes, "words-and-pairs")
    short = _passed(hot, bits, largest_bitmap)

    def longer(shard: Shard) -> list[np.ndarray]:
        pairs = shard.inside(2)
        pairs &= Passed(*short.value)(shard.cells(2))
        return [shard.cells(n)[_runs(shard, pairs, n)] for n in (3, 4)]

    long = _passed(_sketch(own, longer, least, shard_bytes, "longer")[0], bits, largest_bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short_map, long_map = Passed(*short.value), Passed(*long.value)
        for shard in _shards(batches, shard_bytes):
            found = [(len(p), b" ".join(p)) for p in _phrases(shard, short_map, long_map)]
            sizes, phrases, f = [n for n, _ in found], [p for _, p in found], []
            for k in range(0, len(found), AUTOMATON_PHRASES):
                f.append(_scan(shard, [p.decode() for p in phrases[k: k + AUTOMATON_PHRASES]]))
            if len(shard.all):
                sizes, phrases = [*sizes, 0], [*phrases, b""]
                f.append(np.array([len(shard.all)]))
            if phrases:
                yield _packed(shard.lang, np.array(sizes, np.int32), phrases, np.concatenate(f), bits)

    def add(table: pa.Table) -> pa.Table:
        lists = [table[c].combine_chunks() for c in ("sizes", "phrases", "counts")]
        langs = table["lang"].combine_chunks().take(pc.list_parent_indices(lists[0]))
        size, phrase, f = (x.flatten() for x in lists)
        summed = pa.table({"lang": langs, "size": size, "phrase": phrase, "f": f}).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("f", "sum")])
        summed = pa.table({"lang": summed["lang"], "size": summed["size"], "phrase": summed["phrase"], "f": summed["f_sum"]})
        return summed.filter(pc.or_(pc.equal(summed["size"], 0), pc.greater_equal(summed["f"], least)))

    packed = own.mapInArrow(count, "bucket long, lang string, sizes array<int>, phrases array<string>, counts array<long>")
    return packed.groupBy("bucket").applyInArrow(add, "lang string, size int, phrase string, f long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD_BYTES, largest_bitmap: int = LARGEST_BITMAP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of two to four words.

    docs needs lang and text.  A-Z count as lower case; pieces end at . , ; : ! ? and line ends, and
    words at spaces and tabs.  A null text is empty, a null lang is the lang und; a text without words
    adds nothing; rows count as often as they occur.  a, l and r are the counts of the phrase and of the
    two parts of its cut with the lowest score, the first of equals; n counts the lang's words.  A phrase
    goes if a longer candidate around it has 80 % of its count.  Equal scores are ordered by a, then by the
    phrase's bytes.  Further columns are not looked at.  No rows give no rows.
    """
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    counts = materialise(phrase_counts(docs, least, shard_bytes, largest_bitmap), "counts")
    known = counts.filter("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda x: F.array_join(x, " ")
    left, right = joined(F.slice("words", F.lit(1), F.col("k"))), joined(F.slice("words", F.col("k") + 1, F.lit(LONGEST)))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), right.alias("part"))))
    parts = materialise(cuts.select("lang", "phrase", "a", "k", ends.alias("x")).select("lang", "phrase", "a", "k", "x.*"), "parts")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    named = materialise(known.join(uses, ["lang", "part"]), "named")
    both = join_groups(parts, named, ["lang", "part"], "uses", parts.count())
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    scored = both.groupBy("lang", "phrase", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    scored = scored.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    spans = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    inner = F.explode(F.array(*(F.when(F.col("size") >= i + n - 1, joined(F.slice("words", i, n))) for i, n in spans))).alias("phrase")
    around = phrases.filter("size > 2").select("lang", F.col("phrase").alias("longer"), F.col("a").alias("f"), inner).filter("phrase is not null and phrase <> longer")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = least_cut.join(around, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (exact("f") * 100 < exact("a") * 80)).drop("f")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
