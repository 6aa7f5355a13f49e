"""Tables in the shared folder; see kithline.scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kithline import scratch
from kithline.scratch import free_name, let_go, shared_dir

__all__ = ["free_name", "let_go", "materialise", "shared_dir"]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """kithline.scratch.materialise; what led to the table is let go, so that the driver holds a step at a time."""
    out = scratch.materialise(df, name)
    let_go(df.sparkSession)
    return out
