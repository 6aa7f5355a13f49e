"""The life of articles as a stream with state, and a sink that goes on where it stopped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "article_id long, at timestamp, was string, now string, why string"
#: What an event does to an article in a state.  Anything else changes nothing.
MOVES = {("pending", "claimed"): "processing", ("processing", "extracted"): "done", ("processing", "no_result"): "pending", ("processing", "error"): "failed", ("failed", "reset"): "pending"}


def moved(state: str | None, since: dt.datetime | None, events, limit: dt.timedelta, until: dt.datetime | None = None):
    """(at, was, now, why) of each change of one article, then its state and when that began.

    events: (ts, kind, empty) in the order of time.  An article without content fails as it arrives;
    one that is processed for longer than limit is pending again, from that moment.
    """
    out = []

    def to(at, now, why):
        nonlocal state, since
        out.append((at, state, now, why))
        state, since = now, at

    for ts, kind, empty in events:
        if state == "processing" and ts > since + limit:
            to(since + limit, "pending", "timeout")
        if state is None:
            if kind == "arrived":
                to(ts, "failed" if empty else "pending", kind)
        elif (state, kind) in MOVES:
            to(ts, MOVES[state, kind], kind)
    if until is not None and state == "processing" and since + limit <= until:
        to(since + limit, "pending", "timeout")
    return out, state, since


def transitions(stream: DataFrame, limit: dt.timedelta, late: str = "1 hour") -> DataFrame:
    """(article_id, at, was, now, why): the changes of state that a stream of events brings.

    stream: article_id, ts, kind (arrived, claimed, extracted, no_result, error, reset), empty.  The state
    of an article is its status and since when it has it.  A timer on event time ends a processing that
    no event ends; an event that comes later than the limit ends it first, so what comes out does
    not depend on where micro-batches are cut.  Events later than the watermark are dropped.
    """
    from pyspark.sql.streaming import StatefulProcessor

    seconds = limit.total_seconds()

    class Machine(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "status string, since timestamp")

        def _known(self):
            if not self.state.exists():
                return None, None
            status, since = self.state.get()
            return status, pd.Timestamp(since).to_pydatetime().replace(tzinfo=None)

        def _keep(self, status, since) -> None:
            self.state.update((status, since))
            if status == "processing":
                ends = since.replace(tzinfo=dt.timezone.utc).timestamp() + seconds
                self.handle.registerTimer(int(ends * 1000))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            own = [(t.to_pydatetime().replace(tzinfo=None), k, bool(e)) for t, k, e in zip(events["ts"], events["kind"], events["empty"], strict=True)]
            out, status, since = moved(*self._known(), own, limit)
            if out:
                self._keep(status, since)
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["article_id", "at", "was", "now", "why"]).astype({"at": "datetime64[us]", "article_id": "int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            status, since = self._known()
            out, now, began = moved(status, since, [], limit, dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).replace(tzinfo=None))
            if out:
                self._keep(now, began)
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["article_id", "at", "was", "now", "why"]).astype({"at": "datetime64[us]", "article_id": "int64"})

        def close(self) -> None:
            pass

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = stream.select("article_id", "event_id", "ts", "kind", "empty").withWatermark("ts", late)
    return own.groupBy("article_id").transformWithStateInPandas(Machine(), TRANSITIONS, "append", "eventtime")


def transitions_of(events: DataFrame, limit: dt.timedelta, late: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """What transitions gives for all events at once, as if the stream ended with them."""
    last = events.agg(F.max("ts").alias("last"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        own = [(t.to_pydatetime().replace(tzinfo=None), k, bool(e)) for t, k, e in zip(rows["ts"], rows["kind"], rows["empty"], strict=True)]
        out, _, _ = moved(None, None, own, limit, rows["last"].iloc[0].to_pydatetime().replace(tzinfo=None) - late)
        return pd.DataFrame([(rows["article_id"].iloc[0], *x) for x in out], columns=["article_id", "at", "was", "now", "why"])

    return events.crossJoin(F.broadcast(last)).groupBy("article_id").applyInPandas(run, TRANSITIONS)


class Stopped(Exception):
    """Raised by a step that a test stops."""


def ledgered(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, before_commit: Callable[[int], None] | None = None):
    """Write what step makes of each micro-batch below path, each batch once, whatever stops in between.

    A batch is staged in a folder of its own number, which a repetition overwrites, and counts from the
    moment its line stands in the ledger.  Stopped before that, the batch is made again from the same rows;
    stopped after it, it is found in the ledger and left alone.
    """
    def batch(rows: DataFrame, number: int) -> None:
        if number in committed(rows.sparkSession, path):
            return
        step(rows).write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        if before_commit is not None:
            before_commit(number)
        rows.sparkSession.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str) -> set[int]:
    """The numbers in the ledger: one for each micro-batch."""
    from pyspark.errors import AnalysisException

    try:
        return {r.number for r in spark.read.schema("number long").parquet(f"{path}/ledger/*").collect()}
    except AnalysisException:  # no batch yet
        return set()


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that the ledger has."""
    numbers = sorted(committed(spark, path))
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/batch={n}" for n in numbers)).drop("batch")
