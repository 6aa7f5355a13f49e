"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Frequent words are compiled into an automaton that shares common prefixes and suffixes.
Each transition carries the number of accepted words that come before it, so the sum along
a word's path is the word's number, and under that number its token ids are stored.  The
automaton and the ids are flat arrays in one file, which Spark brings to every executor and
its workers map into memory read-only, so they share it.  A word that is not accepted is
merged by the tokenizer's rules.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame

from kithline.llm.frequent import LONGEST, frequent_pieces
from kithline.llm.shipping import ship
from kithline.llm.workers import kept, sole

TABLE_SIZE = 50_000
CACHE_SIZE = 400_000
#: Up to so many symbols a word is merged by looking at all its pairs, which is faster than a heap.
SHORT = 48


# --- the transducer -------------------------------------------------------------------


def build_automaton(words: list[bytes]) -> bytes:
    """The minimal acyclic automaton of sorted distinct words, as flat arrays.

    Layout: three counts; for each state the begin of its transitions (one more at the end)
    and whether it accepts; for each transition its byte, its target and its output.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settled(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    # The path of the last word, as [accepts, transitions]; its nodes are not settled yet.
    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        if word <= last and (last or path[0][0]):
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1].append((last[i - 1], settled(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], settled(path.pop())))
    root = settled(path[0])

    # States are settled after their targets, so accepted words can be counted in order.
    size, begin, label, target, output = [], [0], [], [], []
    for accepts, moves in states:
        n = int(accepts)
        for b, to in moves:
            label.append(b)
            target.append(to)
            output.append(n)
            n += size[to]
        size.append(n)
        begin.append(len(label))
    arrays = (begin, [int(a) for a, _ in states], label, target, output)
    return struct.pack("<3i", len(states), len(label), root) + b"".join(np.array(a, "<i4").tobytes() for a in arrays)


class Automaton:
    """Finds a word's number in what build_automaton made."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        n, m, self.root = struct.unpack_from("<3i", view)
        at, self.arrays = 12, []
        for size in (n + 1, n, m, m, m):
            self.arrays.append(view[at: at + 4 * size].cast("i"))
            at += 4 * size
        self.size = at
        #: A label is one byte, so a state's transition is found by a search of bytes.
        self.labels = np.frombuffer(self.arrays[2], "<i4").astype(np.uint8).tobytes()

    def number(self, word: bytes) -> int:
        """-1 if the word is not accepted."""
        begin, accepts, _, target, output = self.arrays
        find, state, total = self.labels.find, self.root, 0
        for b in word:
            at = find(b, begin[state], begin[state + 1])
            if at < 0:
                return -1
            total += output[at]
            state = target[at]
        return total if accepts[state] else -1


# --- the tokenizer's rules ------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself if it is one, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Below this code point texts are normalised and split here; texts with others by the library.
PLAIN_END = 0x300


def _plain_pattern() -> re.Pattern:
    def of(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, space = of("L"), of("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class Rules:
    """What the tokenizer's file says, for files of this kind: byte-level BPE with word ends."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        ok = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        if not ok or parsed["decoder"] is not None or parsed["post_processor"] is not None:
            raise ValueError("not a byte-level BPE tokenizer with word ends")
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.name = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        if not all(x in self.vocab and x + self.end in self.vocab for x in letters.values()) or not all(a in self.vocab and b in self.vocab and a + b in self.vocab for a, b in pairs):
            raise ValueError("a letter or a rule's symbol has no id")
        #: Symbols are their ids: the rank of a pair, what each rank makes, and the ids of a byte within and at the end of a word.
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.end] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letter = letters
        self.pattern = _plain_pattern()
        self.library = Tokenizer.from_str(spec.decode())
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]")

    def split(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if self.beyond.search(text):
            normal = self.library.normalizer.normalize_str(text)
            back = {v: k for k, v in self.letter.items()}
            return [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.pattern.findall(text.lower())

    def merge(self, word: str) -> list[int]:
        """The ids of one word: of all neighbours that a rule joins, the first rule's leftmost are joined, again and again."""
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return self._merge_short(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] = new = self.made[best]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, symbols[i + 1]), none)
        return symbols

    def _merge_long(self, own: list[int]) -> list[int]:
        symbols: list[int | None] = list(own)
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.made[best], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s is not None]


class Lexicon(dict):
    """By word: the bytes of its ids, and its decoded text."""

    def __init__(self, spec: bytes, path: str):
        """path: the file of compile_lexicon; it is mapped read-only, so all workers of a machine share its pages."""
        super().__init__()
        self.rules = _rules(spec)
        with open(path, "rb") as f:
            self.memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.automaton = Automaton(self.memory)
        rest = memoryview(self.memory)[self.automaton.size:]
        (n,) = struct.unpack_from("<i", rest)
        self.bounds = rest[4: 4 + 4 * (n + 1)].cast("i")
        self.ids = rest[4 + 4 * (n + 1):].cast("I")

    def entry(self, ids: list[int]) -> tuple[bytes, str]:
        name = self.rules.name
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([name[i] for i in ids])

    def __missing__(self, word: str) -> tuple[bytes, str]:
        number = self.automaton.number(word.encode()) if len(word) <= LONGEST else -1
        if number >= 0:
            found = self.entry(self.ids[self.bounds[number]: self.bounds[number + 1]].tolist())
        else:
            found = self.entry(self.rules.merge(word))
        if len(word) <= LONGEST:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit numbers, and the decoded text."""
        rules = self.rules
        found = []
        for i, part in enumerate(rules.cut.split(text) if rules.cut and "<|" in text else [text]):
            if i % 2:
                found.append(self.entry([rules.special[part]]))
            elif part:
                found += map(self.__getitem__, rules.split(part))
        return b"".join([a for a, _ in found]), " ".join([b for _, b in found])


def compile_lexicon(spec: bytes, words: list[str]) -> bytes:
    """The transducer of the words, then their ids by the word's number."""
    rules = Rules(spec)
    keys = sorted({w.encode() for w in words if w})
    ids = [rules.merge(k.decode()) for k in keys]
    bounds = np.cumsum([0, *map(len, ids)])
    return build_automaton(keys) + struct.pack("<i", len(keys)) + bounds.astype("<i4").tobytes() + np.array([i for x in ids for i in x], "<u4").tobytes()


def _lexicon(spec: bytes, name: str) -> Lexicon:
    """The lexicon in a file that Spark brought to this executor."""
    own = kept("bpe_lexicon")
    if own.get("name") != name:
        own["lexicon"] = None
        own |= {"lexicon": Lexicon(spec, SparkFiles.get(name)), "name": name}
    return own["lexicon"]


def _distributed(context: SparkContext, table: bytes) -> str:
    """The name of a file with these bytes, which Spark's file server brings to each executor."""
    handle, path = tempfile.mkstemp(prefix="kithline-lexicon-", suffix=".bin")
    with os.fdopen(handle, "wb") as f:
        f.write(table)
    context.addFile(path)
    return os.path.basename(path)


def _rules(spec: bytes) -> Rules:
    own = kept("bpe_lexicon")
    if own.get("spec") != spec:
        own |= {"rules": Rules(spec), "spec": spec}
    return own["rules"]


def encode(docs: DataFrame, tokenizer_path: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row per row of docs.

    docs needs doc_id and text.  ids: little-endian unsigned 32-bit numbers, as the library
    gives them for the whole text with add_special_tokens=False; decoded: as its
    decode(ids, skip_special_tokens=False).  A null or empty text has no tokens.  Strings of
    special tokens in a text are these tokens.  No rows give no rows.
    """
    ship(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    context = docs.sparkSession.sparkContext
    source = context.broadcast(spec)

    def split(text: str) -> list[str]:
        return _rules(source.value).split(text)

    table = compile_lexicon(spec, frequent_pieces(docs, split, table_size, owner="bpe_lexicon"))
    name = _distributed(context, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lexicon(source.value, name)
        for batch in batches:
            found = [own.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(a) // 4 for a, _ in found], pa.int64()), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sole("bpe_lexicon", run), f"doc_id {kind}, n_tokens long, ids binary, decoded string")
