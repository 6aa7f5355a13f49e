"""Makes this library importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark as a Python file, once for each application.

    Spark's file server passes it on to the executors, so they need neither an
    installation nor a folder in common with the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_kithline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="kithline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._kithline_shipped = True
