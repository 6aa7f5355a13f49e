"""Frequent pieces of text, counted over all documents within bounded memory."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.workers import sole

#: Longer pieces are rare; they are never put in a table.
LONGEST = 64


def frequent_pieces(docs: DataFrame, split: Callable[[str], Iterable[str]], size: int, each: int = 20_000, owner: str = "frequent") -> list[str]:
    """About the size most frequent pieces, which is what comes to the driver at most.

    Each task counts its own pieces and hands on the each most frequent; only these
    summaries are shuffled, never the pieces.  A task forgets its rarest pieces when it
    holds more than eight times as many, so the choice is approximate.  The results of the
    operators that use it do not depend on it.  owner: whose tables split uses in a worker.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
                if len(seen) > 8 * each:
                    seen = Counter({p: n for p, n in seen.most_common(2 * each) if len(p) <= LONGEST})
        top = [(p, n) for p, n in seen.most_common(each) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    summed = docs.select("text").mapInArrow(sole(owner, count), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in summed.orderBy(F.desc("n"), "piece").limit(size).collect()]
