"""Structured Streaming forms of ingest, positions, decisions and indicators.

All run with trigger(availableNow=True), which gives the batch result, or continuously.
State that a watermark does not bound is kept in tables, not in the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.operators.listing import latest_status


def new_articles(spark: SparkSession, source: DataFrame, table: str, checkpoint: str, at_once: bool = True):
    """Append articles whose URL the table lacks; each micro-batch is joined with the table.  Articles without a URL are left out."""

    def batch(rows: DataFrame, _: int) -> None:
        # A micro-batch has a session of its own; the caller's may remember the table's old files.
        session = rows.sparkSession
        own = rows.filter("url is not null").dropDuplicates(["url"])
        if session.catalog.tableExists(table):
            own = own.join(session.table(table).select("url"), "url", "left_anti")
        own.write.mode("append").saveAsTable(table)
        spark.catalog.refreshTable(table)

    return _start(source.writeStream.foreachBatch(batch), checkpoint, at_once)


def process_batches(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, at_once: bool = True):
    """Hand each micro-batch (a file source sets its size by maxFilesPerTrigger) to step; the checkpoint resumes after a stop."""
    return _start(source.writeStream.foreachBatch(step), checkpoint, at_once)


def _start(writer, checkpoint: str, at_once: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if at_once else writer.trigger(processingTime="4 hours")).start()


def latest_positions(stream: DataFrame) -> DataFrame:
    """(vid, lat, lng, reported_at) of the latest event time; one row of state for each vid."""
    return stream.groupBy("vid").agg(F.max_by(F.struct("lat", "lng", "reported_at"), "reported_at").alias("p")).select("vid", "p.*")


def sliding_counts(stream: DataFrame, ts: str = "ts", size: str = "7 days", slide: str = "1 day", late: str = "1 day", *by: str) -> DataFrame:
    """Counts in sliding windows; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events without a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_within(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of a key within the watermark, with bounded state."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def decision_view(spark: SparkSession, table: str) -> DataFrame:
    """The newest decision of each pair of an append-only table."""
    return latest_status(spark.table(table))


def retrain_every(source: DataFrame, count_table: str, every: int, train: Callable[[], None], checkpoint: str):
    """Call train whenever another `every` decisions have come; the count is a table, so it survives a restart."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        counts = spark.table(count_table) if spark.catalog.tableExists(count_table) else spark.createDataFrame([], "batch long, n long")
        seen = counts.filter(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        n = rows.count()
        # A batch that is run again after a stop is counted once.
        if counts.filter(F.col("batch") == number).isEmpty():
            spark.createDataFrame([(number, n)], "batch long, n long").write.mode("append").saveAsTable(count_table)
        source.sparkSession.catalog.refreshTable(count_table)
        if (seen + n) // every > seen // every:
            train()

    return _start(source.writeStream.foreachBatch(batch), checkpoint, True)
