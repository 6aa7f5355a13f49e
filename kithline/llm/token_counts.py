"""Token counts of a sentencepiece BPE model, by a two-tier lookup on the map side.

No piece of the model has a space inside or at its end, so a text can be cut before each run
of spaces and the counts of these pre-tokens added.  Lengths of frequent pre-tokens are
broadcast as a table of bounded size; a worker encodes what it misses and keeps the
length in a cache of bounded size.  Nothing is shuffled but short summaries of the tasks'
most frequent pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kithline.llm.frequent import LONGEST, frequent_pieces
from kithline.llm.shipping import ship

TABLE_SIZE = 50_000
CACHE_SIZE = 1_000_000
#: Stands for a space in the pieces of a model.
SPACE_MARK = "▁"


def check_model(model: bytes) -> None:
    """Raise ValueError for a model whose counts cannot be added over pre-tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
        raise ValueError("a piece of the model goes beyond a pre-token")
    for text in ("a  b", " a", "a ", "\ta\n", "ﬁ A"):
        joined = "".join(sp.id_to_piece(i) for i in sp.encode(text))
        plain = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if joined.replace("<0x09>", "\t").replace("<0x0A>", "\n").replace("<0xEF><0xAC><0x81>", "ﬁ") != plain:
            raise ValueError("the model changes texts before it encodes them")


class Lengths(dict):
    """Numbers of tokens by pre-token, without the space before it."""

    def __init__(self, model: bytes, known: dict[str, int]):
        import sentencepiece

        super().__init__(known)
        self.sp, self.limit = sentencepiece.SentencePieceProcessor(model_proto=model), len(known) + CACHE_SIZE
        self.known = known

    def __missing__(self, piece: str) -> int:
        # The library adds the space before the piece itself, but not to an empty text.
        n = len(self.sp.encode(piece)) if piece else self.spaces(1)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n

    def spaces(self, n: int) -> int:
        """Of n spaces that end a text."""
        return len(self.sp.encode("a" + " " * n)) - len(self.sp.encode("a"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE_MARK in text:  # a space and this character are the same to the model
            text = text.replace(SPACE_MARK, " ")
        pieces = text.split(" ")
        if "" not in pieces:
            return sum(map(self.__getitem__, pieces))
        total, run = 0, 0
        for p in pieces:
            if p:
                total += self[" " * run + p]
                run = 0
            else:
                run += 1
        return total + (self.spaces(run) if run else 0)


_LENGTHS: dict[int, Lengths] = {}


def _lengths(shared) -> Lengths:
    if shared.id not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[shared.id] = Lengths(*shared.value)
    return _LENGTHS[shared.id]


class _Shared:
    """A broadcast variable and an identity by which a worker knows it again."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _split(text: str) -> list[str]:
    return text.split(" ")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    docs needs doc_id and text.  Counts are those of the library for the whole text, without
    begin or end marks; special strings are plain text to it.  A null or empty text has no
    bytes and no tokens.  over_limit: more than limit tokens.  No rows give no rows.
    """
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model)
    lengths = Lengths(model, {})
    table = {p: lengths[p] for p in frequent_pieces(docs, _split, table_size) if p}
    shared = _Shared(docs.sparkSession.sparkContext.broadcast((model, table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lengths(shared)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [own.count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")
