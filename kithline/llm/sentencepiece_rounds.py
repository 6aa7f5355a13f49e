"""Encoding and decoding with a sentencepiece BPE model, by merge rounds over flat arrays.

No piece of the model has a space inside or at its end, so a text is cut before each run of spaces,
and a word further where two characters stand side by side that no piece has side by side.  The
symbols of all words that a worker has not met lie in one array.  In a round each word finds its
best rank among adjacent pairs, and all its pairs of that rank are merged at once, from the left
where they overlap; words without a pair leave the array.  This equals merging one pair at a time
unless a merge makes a pair of a better rank beside it.  That is looked at where a piece can do so,
and a word in which it happens has its leftmost pair merged alone in that round.

Nothing is shuffled.  A worker keeps the ids of short words in a cache of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kithline.llm.shipping import ship
from kithline.llm.token_counts import SPACE_MARK, check_model

#: Words of more characters are not kept, nor are more words than this.
LONGEST, CACHE_SIZE = 64, 300_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 4_000_000
NEVER = np.iinfo(np.int32).max


class Model:
    """Tables of a model: symbols, pairs with their ranks, and the bytes of pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.end, self.size = sp.eos_id(), size
        if any(sp.is_unused(i) for i in range(size)) or self.end < 0:
            raise ValueError("unused pieces or no end id")

        # Characters of pieces that are no piece themselves are symbols too.
        chars = sorted({c for p in ids for c in p})
        number = dict(ids)
        for c in chars:
            number.setdefault(c, size + len(number))
        self.stranger = size + len(number) + 1
        self.base = self.stranger + 1
        self.points = np.array([ord(c) for c in chars], np.int64)
        self.symbols = np.array([number[c] for c in chars], np.int64)
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        rank = {p: order[sp.get_score(i)] for p, i in ids.items()}

        keys, ranks, merged, beside = [], [], [], set()
        #: Pieces that are a part of a piece that ranks before them.
        self.early = np.zeros(self.base, bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                beside.add(ord(p[k - 1]) << 32 | ord(p[k]))
                a, b = p[:k], p[k:]
                if a in number and b in number:
                    keys.append(number[a] * self.base + number[b])
                    ranks.append(rank[p])
                    merged.append(i)
                    for x in (a, b):
                        self.early[number[x]] |= len(x) > 1 and rank[x] >= rank[p]
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.merged = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(merged, np.int64)[at]
        self.beside = np.array(sorted(beside), np.int64)

        self.of_byte = np.full(256, -1, np.int64)
        out = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.of_byte[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(b"" if special[i] else p.replace(SPACE_MARK, " ").encode())
        if (self.of_byte < 0).any():
            raise ValueError("the model has no pieces for single bytes")
        self.length = np.array([len(b) for b in out], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table, -1 for those that make no piece."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; space marks stand for spaces."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, code), len(self.points) - 1)
        sym = np.where(self.points[at] == code, self.symbols[at], self.stranger)
        # A cut before each word, and between characters that no piece has side by side.
        cut = np.zeros(len(code), bool)
        cut[(np.cumsum(size) - size)[size > 0]] = True
        both = code[:-1] << 32 | code[1:]
        found = np.minimum(np.searchsorted(self.beside, both), len(self.beside) - 1)
        cut[1:] |= self.beside[found] != both
        sym, place = self._merge(sym, np.flatnonzero(cut))

        # Characters without a piece are written as their bytes.
        odd = np.flatnonzero(sym >= self.size)
        owner = np.searchsorted(np.cumsum(size), place, "right")
        if len(odd):
            own = [chr(c).encode() for c in code[place[odd]]]
            many = np.ones(len(sym), np.int64)
            many[odd] = [len(b) for b in own]
            sym, owner = np.repeat(sym, many), np.repeat(owner, many)
            sym[sym >= self.size] = self.of_byte[np.frombuffer(b"".join(own), np.uint8)]
        ends = np.searchsorted(owner, np.arange(len(words)), "right") * 4
        data = sym.astype("<i4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and where each began; first: where the runs begin that merges stay within."""
        place, done = np.arange(len(sym)), []
        rank = np.full(len(sym), NEVER, np.int32)
        into = np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            pair = self._pairs(sym[at], sym[at + 1])
            rank[at], into[at] = np.where(pair >= 0, self.ranks[pair], NEVER), self.merged[pair]

        last = np.zeros(len(sym), bool)
        last[first[1:] - 1] = True
        last[-1:] = True
        look(np.flatnonzero(~last))
        while len(sym):
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            over = best == NEVER
            if over.any():  # these words are ready: the others close ranks
                ready = np.repeat(over, size)
                done.append((sym[ready], place[ready]))
                sym, place, rank, into, last = (x[~ready] for x in (sym, place, rank, into, last))
                best, size = best[~over], size[~over]
                first = np.cumsum(size) - size
                if not len(sym):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, size))
            fresh = np.diff(chosen, prepend=-2) > 1  # pairs that overlap: every second one, from the left
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = self._apart(chosen[(np.arange(len(chosen)) - begin) % 2 == 0], sym, into, last, first)
            sym[chosen] = into[chosen]
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            first, chosen = moved[first], moved[chosen]
            sym, place, rank, into, last = (x[keep] for x in (sym, place, rank, into, last))
            rank[chosen] = NEVER
            touched = np.unique(np.concatenate([chosen, chosen[chosen > 0] - 1]))
            look(touched[~last[touched]])
        if not done:
            return sym, place
        sym, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return sym[order], place[order]

    def _apart(self, chosen: np.ndarray, sym: np.ndarray, into: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The chosen pairs, but the leftmost one only of a word where a merge would make a pair that goes before the others."""
        near = np.flatnonzero(self.early[into[chosen]])
        if not len(near):
            return chosen
        at = chosen[near]
        made, own = into[at], self._ranked(sym[at], sym[at + 1])
        # Merged from the left: the symbol on the left is merged already, the one on the right is not.
        left = np.where((near > 0) & (chosen[near - 1] == at - 2), into[at - 2], sym[at - 1])
        inner = (at > 0) & ~last[at - 1]
        right = sym[np.minimum(at + 2, len(sym) - 1)]
        clash = inner & (self._ranked(left, made) <= own) | ~last[at + 1] & (self._ranked(made, right) <= own)
        if not clash.any():
            return chosen
        owner = np.searchsorted(first, chosen, "right")
        bad = np.isin(owner, owner[near[clash]])
        return chosen[~bad | (np.diff(owner, prepend=-1) > 0)]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = self._pairs(left, right)
        return np.where(pair >= 0, self.ranks[pair], NEVER)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids end at ends, and where the texts end; a text's first space is the model's own."""
        size = self.length[ids]
        stop = np.cumsum(size)
        out = self.bytes[np.repeat(self.start[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        stop = np.concatenate([[0], stop])[np.concatenate([[0], ends])]
        begin = stop[:-1][np.diff(stop) > 0]
        begin = begin[out[begin] == 32]
        keep = np.ones(len(out), bool)
        keep[begin] = False
        return out[keep], stop - np.searchsorted(begin, stop)


class Encoder:
    """Encodes texts, and remembers short words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Words with the spaces before them but one; spaces that end the text are a word of their own."""
        if not text:
            return []
        words = text.replace(SPACE_MARK, " ").split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        return [*out, " " * run] if run else out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text's after another's with an end id after each, and where each text's end."""
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        # What is one space more than the word, unless it is spaces only.
        full = [(w if not w.strip(" ") else " " + w).replace(" ", SPACE_MARK) for w in new]
        made = dict(zip(new, self.model.words(full), strict=True))
        if len(self.known) + len(made) > CACHE_SIZE:
            have = self.known | made
            self.known = {}
        else:
            have = self.known
            have.update(made)
        end = np.array([self.model.end], "<i4").tobytes()
        parts = [b"".join([*map(have.__getitem__, c), end]) for c in cut]
        if have is self.known:
            for w in new:
                if len(w) > LONGEST:
                    del have[w]
        return np.frombuffer(b"".join(parts), "<i4"), np.cumsum([len(p) // 4 for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(broadcast, name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(Model(broadcast.value))
    return _ENCODERS[name]


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= GROUP_CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row per row of docs.

    docs needs doc_id and text.  ids are the library's for the whole text, with an end id; decoded is
    what the library makes of them.  A null or empty text has the end id alone and decodes to an empty
    text; special strings are plain text.  Repeated rows are encoded each.  Further columns are not
    looked at.  No rows give no rows.
    """
    import uuid

    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = f.read()
    check_model(proto)
    Model(proto)
    shared, name = docs.sparkSession.sparkContext.broadcast(proto), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            for a, b in _grouped(texts):
                ids, ends = encoder(texts[a:b])
                data, stops = encoder.model.decode(ids, ends)
                offsets = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), lists, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")
