"""Tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only where the setting is absent (a local session, as in tests) a folder of this
    machine is made and used; a cluster must name a shared one.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(context, "_kithline_scratch", None)
    if known is None:
        known = context._kithline_scratch = tempfile.mkdtemp(prefix="spark-kithline-")
    return f"file://{os.path.abspath(known)}"


def let_go(spark: SparkSession) -> None:
    """Collect what earlier steps left behind in the driver.

    Spark removes the shuffle files and broadcasts of a finished plan, and hands memory back, only
    once the driver's heap is collected, and it holds a plan as long as Python does.  Arrow
    keeps the pages of tables that are gone, too.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that were running, and the
    rows that later plans read are the same rows each time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kithline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """materialise, and aggregates of the rows, read from what was written.

    The aggregates are a second, narrow read: an Observation would leave its manager in the
    session, and plans that carry the session in a closure could not be sent any more.  Rounds
    of a loop come through here, so what led to the table is let go.
    """
    written = materialise(df, name)
    found = written.agg(*(c.alias(k) for k, c in sums.items())).first().asDict()
    let_go(df.sparkSession)
    return written, found


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
