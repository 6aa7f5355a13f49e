"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of the bytes of a word:
a byte is predicted from the five before it.  The counts at this order are the class's
own; the orders below use continuation counts that both classes share, so an expression
that one class has rarely or never seen falls back to the same estimate in both and says
little.  The logarithm of the ratio of a word's two likelihoods is summed over its bytes.

A text is described by length-normalised ratios: the mean over all its words, the largest
mean over any 1, 4 and 16 consecutive words, as abuse is often a short part of a long text,
the means of the 2, 3, 5 and 8 largest among its distinct words, as an expression of several
words is rarely met by chance, the shares of words whose ratio is high, and the numbers of words
by which these are judged.  A logistic function of these gives the score.

The logistic function is fitted on the rows of all training folds, each scored by a model
that has not counted its fold; the final model counts them all.  The shared estimates carry no
label and are the same in all models.  They cancel out in the ratio of unseen bytes, so scoring
needs two tables: ratios of known six-byte sequences and of known contexts.  All of them are
kept.  They are broadcast in blocks of about block_grams sequences, each with its contexts; a
worker holds the first few and loads the others one after another, so that its memory does
not grow with the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.scratch import materialise
from kithline.llm.shipping import ship
from kithline.llm.words import _LOWER, parts, pieces, text_bytes
from kithline.llm.workers import sole

ORDER = 6
DISCOUNT = 0.75
#: Sequences that are collected and broadcast at once, and the blocks that a worker keeps in memory.
BLOCK_GRAMS = 1 << 20
HELD_BLOCKS = 4
WINDOWS = (1, 4, 16)
LARGEST = (2, 3, 5, 8)
HIGH = (1.0, 2.0)
FEATURES = 1 + len(WINDOWS) + len(LARGEST) + len(HIGH) + 2
FOLDS = 5
#: Folds by crc32 of the doc_id: one is held out.
HELD_OUT = 0
LEARNED = tuple(f for f in range(FOLDS) if f != HELD_OUT)
#: Used where a logistic function cannot be fitted: the largest word's ratio less this.
PLAIN_BIAS = -8.0

_BEGIN, _END = 2, 3
_U = np.uint64


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _word_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first word of each text, word's number among distinct words, begin and end of each distinct word)."""
    data, _ = text_bytes(column)
    starts, ends, hashes, count = [], [], [], np.zeros(len(column), np.int64)
    for p in pieces(column, 0, lower=True):
        hashes.append(p.words.hashes())
        starts.append(p.words.start + p.offset)
        ends.append(p.words.end + p.offset)
        np.add.at(count, p.rows, np.diff(p.words.first))
    first = np.concatenate([[0], np.cumsum(count)])
    if not hashes:
        return data, first, np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    start, end = np.concatenate(starts), np.concatenate(ends)
    _, at, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return data, first, of, np.stack([start[at], end[at]], 1)


def _grams(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of each word, and its end: the last ORDER bytes as one number, and the word."""
    length = spans[:, 1] - spans[:, 0]
    size = length + ORDER  # five begin marks and an end mark
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(spans)), size)
    inside = np.arange(int(size.sum())) - begin[word] - (ORDER - 1)
    padded = np.full(len(word), _BEGIN, np.uint8)
    real = (inside >= 0) & (inside < length[word])
    padded[real] = _LOWER[data[(spans[:, 0][word] + inside)[real]]]
    padded[inside == length[word]] = _END
    at = np.flatnonzero(inside >= 0)
    key = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        key = (key << 8) | padded[at - (ORDER - 1) + k]
    return key, word[at]


def _small(batches: Iterator[pa.RecordBatch], text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes of text, which bounds the memory of a task; a longer text is alone."""
    for batch in batches:
        for lo, hi, _, _ in parts(batch.column(text), size):
            yield batch.slice(lo, hi - lo)


class Block:
    """Ratios of the known contexts of one block, and of the known sequences that begin with them; a column for each model."""

    def __init__(self, grams: np.ndarray, gram_ratio: np.ndarray, contexts: np.ndarray, context_ratio: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.gram_ratio = grams[by], gram_ratio[by].astype(np.float32)
        by = np.argsort(contexts)
        self.contexts, self.context_ratio = contexts[by], context_ratio[by].astype(np.float32)

    @staticmethod
    def _look_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, np.where(hit, value[at], 0)

    def ratios(self, keys: np.ndarray, model: int = 0) -> np.ndarray:
        """Of each sequence; 0 where this block does not have its context."""
        hit, ratio = self._look_up(keys, self.grams, self.gram_ratio[:, model])
        _, unseen = self._look_up(keys >> 8, self.contexts, self.context_ratio[:, model])
        return np.where(hit, ratio, unseen)


class Model:
    """Ratios of known sequences and contexts in broadcast blocks, and the logistic function."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks
        self.weights = np.zeros(FEATURES)
        self.weights[1], self.bias = 1.0, PLAIN_BIAS
        #: The score of every text if the labels do not tell two classes apart.
        self.constant: float | None = None

    def release(self) -> None:
        """Let a worker forget the tables it has read; the next task reads them from the worker's files again."""
        for block in self.blocks:
            block.__dict__.pop("_value", None)

    def word_ratios(self, data: np.ndarray, spans: np.ndarray, model: int = 0) -> np.ndarray:
        out = np.zeros(len(spans))
        step = 20_000  # bounds the memory for batches of many distinct words
        for lo in range(0, len(spans), step):
            key, word = _grams(data, spans[lo: lo + step])
            distinct, of = np.unique(key, return_inverse=True)
            ratio = np.zeros(len(distinct))
            for i, block in enumerate(self.blocks):
                ratio += block.value.ratios(distinct, model)
                if i >= HELD_BLOCKS:
                    block.__dict__.pop("_value", None)  # the worker reads it from its file again
            out[lo: lo + step] = np.bincount(word, ratio[of], len(spans[lo: lo + step]))
        return out

    def features(self, column: pa.Array, model: int = 0) -> np.ndarray:
        """A row for each text; a text without words has zeros."""
        data, first, of, spans = _word_table(column)
        ratio = self.word_ratios(data, spans, model)
        x = ratio[of]
        total = np.concatenate([[0.0], np.cumsum(x)])
        n = np.diff(first)
        out = np.zeros((len(n), FEATURES))
        some = np.flatnonzero(n)
        out[some, 0] = (total[first[1:]] - total[first[:-1]])[some] / n[some]
        for j, width in enumerate(WINDOWS, 1):
            out[some, j] = out[some, 0]  # shorter texts than the window
            wide = np.flatnonzero(n >= width)
            if not len(wide):
                continue
            mean = (total[width:] - total[:-width]) / width
            # The windows of one text are a run; what lies between two texts' runs is cut off.
            edges = np.stack([first[:-1][wide], first[1:][wide] - width + 1], 1).ravel()
            best = np.maximum.reduceat(np.append(mean, -np.inf), edges)[::2]
            out[wide, j] = best
        if not len(spans):
            return out
        # The distinct words of each text, the largest ratio first.
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * len(spans) + of)
        doc, y = pairs // len(spans), ratio[pairs % len(spans)]
        order = np.lexsort((-y, doc))
        y, cut = y[order], np.searchsorted(doc, np.arange(len(n) + 1))
        total, kinds = np.concatenate([[0.0], np.cumsum(y)]), np.diff(cut)
        j = 1 + len(WINDOWS)
        for k in LARGEST:
            out[:, j] = (total[np.minimum(cut[:-1] + k, cut[1:])] - total[cut[:-1]]) / k
            j += 1
        for high, size in zip(HIGH, (kinds, np.sqrt(kinds)), strict=True):
            above = np.bincount(doc, y > high, len(n))
            out[:, j] = np.where(kinds > 0, above / np.maximum(size, 1), 0)
            j += 1
        out[:, j], out[:, j + 1] = np.log1p(n), np.log1p(kinds)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        z = self.features(column) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of labelled rows of the folds that are learned from; only their texts are shuffled."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(fold("_id") != HELD_OUT)
    # A row that is labelled twice counts once, as toxic if any label says so.
    own = own.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").filter(fold("doc_id") != HELD_OUT)
    # Labels grow with the corpus, so the join is the same sort-merge join at every size.
    return texts.join(own.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", fold("doc_id").cast("int").alias("fold"))


#: Column names of the counts: class 1 or 0 in a fold.
_COUNTS = [f"c{c}_{f}" for c in (1, 0) for f in LEARNED]


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, c1_1 ...): how often each class has each sequence in each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 0):
            data, first, of, spans = _word_table(batch.column(0))
            part = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(first))
            key, word = _grams(data, spans)
            distinct, at = np.unique(key, return_inverse=True)
            counts = [np.bincount(at, np.bincount(of[part == 10 * c + f], minlength=len(spans))[word], len(distinct)).astype(np.int64) for c in (1, 0) for f in LEARNED]
            yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], ["gram", *_COUNTS])

    rows = labelled.select("text", (F.col("toxic") * 10 + F.col("fold")).alias("part")).mapInArrow(sole("toxicity", run), "gram long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _shared_estimates(grams: DataFrame) -> DataFrame:
    """(gram, p): the Kneser-Ney estimate of sequences one byte shorter, from how many bytes precede each.

    A context's sequences, 256 at most, are a window, so a level is dealt by context once.  There
    are at most 256 and 65536 sequences of one and two bytes; these are broadcast.
    """
    of = Window.partitionBy("context")
    counts, levels = grams.select("gram"), []
    for n in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (8 * n)) - 1)
        counts = counts.select(F.col("gram").bitwiseAND(mask).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        counts = materialise(counts, f"continuations{n}")
        levels.append((n, counts))
    lower = None
    for n, own in reversed(levels):
        row = own.withColumn("context", F.shiftright("gram", 8)).select("*", F.sum("n").over(of).alias("total"), F.count("*").over(of).alias("types"))
        if lower is None:
            row = row.withColumn("base", 1 / (F.col("types") + 1))
        else:
            base = lower.select(F.col("gram").alias("short"), F.col("p").alias("base"))
            row = row.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))).join(F.broadcast(base) if n <= 3 else base, "short")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("base")) / F.col("total")
        lower = row.select("gram", p.alias("p"))
    return lower


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, context, r_0, r_1 ..., u_0, u_1 ...): ratios of sequences and of unseen bytes after their contexts.

    Column 0 is of the model of all folds, column f of the model without fold f.
    """
    context = F.shiftright("gram", 8)
    models = {m: [f for f in LEARNED if f != m] for m in (0, *LEARNED)}
    classes = [(m, c) for m in models for c in (1, 0)]
    grams = counts.select("gram", context.alias("context"), *(sum((F.col(f"c{c}_{f}") for f in models[m]), F.lit(0)).alias(f"n{c}_{m}") for m, c in classes))
    of = Window.partitionBy("context")  # 256 sequences at most
    row = grams.select("*", *(x for m, c in classes for x in (F.sum(f"n{c}_{m}").over(of).alias(f"total{c}_{m}"), F.count_if(F.col(f"n{c}_{m}") > 0).over(of).alias(f"types{c}_{m}")))).withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1)))
    row = row.join(_shared_estimates(counts).select(F.col("gram").alias("short"), "p"), "short")

    def likelihood(m: int, c: int) -> Column:
        own = (F.greatest(F.col(f"n{c}_{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types{c}_{m}") * F.col("p")) / F.col(f"total{c}_{m}")
        return F.when(F.col(f"total{c}_{m}") > 0, own).otherwise(F.col("p"))

    def rest(m: int, c: int) -> Column:
        return F.when(F.col(f"total{c}_{m}") > 0, DISCOUNT * F.col(f"types{c}_{m}") / F.col(f"total{c}_{m}")).otherwise(F.lit(1.0))

    return row.select("gram", "context", *(F.log(of(m, 1) / of(m, 0)).cast("float").alias(f"{k}_{m}") for k, of in (("r", likelihood), ("u", rest)) for m in models))


def fit(docs: DataFrame, labels: DataFrame, block_grams: int = BLOCK_GRAMS) -> Model:
    """The model of the labelled rows of all folds but HELD_OUT.

    The logistic function is fitted on the same rows, each seen by a model that has not
    counted its fold.
    """
    ship(docs.sparkSession)
    labelled = materialise(_labelled(docs, labels), "labelled")
    counts = materialise(_gram_counts(labelled), "grams")
    n = {k: v or 0 for k, v in counts.agg(F.count(F.lit(1)).alias("n_grams"), *(F.sum(c).alias(c) for c in _COUNTS)).first().asDict().items()}
    ones, zeros = ([n[f"c{c}_{f}"] for f in LEARNED] for c in (1, 0))
    if not (any(ones) and any(zeros)):
        model = Model([])
        model.constant = 1.0 if any(ones) else 0.0
        return model
    blocks = max(1, math.ceil(n["n_grams"] / block_grams))
    ratios = materialise(_ratios(counts).withColumn("block", F.pmod(F.xxhash64("context"), F.lit(blocks))), "ratios")
    model = Model(_blocks(ratios, blocks, (0,)))
    # Both classes must be left whichever fold is taken out.
    if sum(map(bool, ones)) > 1 and sum(map(bool, zeros)) > 1:
        apart = Model(_blocks(ratios, blocks, LEARNED))
        _calibrate(model, apart, labelled)
        for block in apart.blocks:
            block.destroy()
    return model


def _blocks(ratios: DataFrame, blocks: int, models: tuple[int, ...]) -> list[Broadcast]:
    """The ratios of these models, dealt by context; a context has 256 sequences at most, so the blocks are even.  Each is collected on its own."""
    out = []
    for b in range(blocks):
        own = ratios.filter(F.col("block") == b).select("gram", "context", *(f"{k}_{m}" for k in "ru" for m in models)).toArrow()
        of = lambda k, own=own: np.stack([own.column(f"{k}_{m}").to_numpy() for m in models], 1)
        contexts, at = np.unique(own.column("context").to_numpy(), return_index=True)
        out.append(ratios.sparkSession.sparkContext.broadcast(Block(own.column("gram").to_numpy(), of("r"), contexts, of("u")[at])))
    return out


def _calibrate(model: Model, apart: Model, labelled: DataFrame) -> None:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 0):
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for i, f in enumerate(LEARNED):
                own = batch.filter(pa.array(folds == f))
                x = apart.features(own.column(0), i)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), own.column(1).cast(pa.float64())], ["x", "label"])
        apart.release()

    rows = materialise(labelled.select("text", "toxic", "fold").mapInArrow(sole("toxicity", run), "x array<double>, label double"), "calibration")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return
    fitted = LogisticRegression(regParam=1e-4, maxIter=100).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    model.weights, model.bias = fitted.coefficients.toArray(), float(fitted.intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    docs needs doc_id and text, labels doc_id and toxic.  Labels of the held-out fold are
    never read, and only the text enters a score.  Null and empty texts are scored by their
    zeros.  Without labelled rows of both classes every score is that of the class there
    is, 0 without any.  A null doc_id is not held out.  No rows give no rows.
    """
    model = fit(docs, labels, block_grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 2):
            score = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        model.release()

    ids = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(sole("toxicity", run), f"doc_id {ids}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The rows of docs whose score is below one half, with all their columns; texts are not shuffled for it.

    docs needs doc_id and text; see score_toxicity.  Null and empty texts have the score of a
    text without words, repeated rows are scored each, a text of any length is scored whole, and
    columns of any other name are passed on.  No rows give no rows.
    """
    model = fit(docs, labels, block_grams)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, at):
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))
        model.release()

    return docs.mapInArrow(sole("toxicity", run), docs.schema)
