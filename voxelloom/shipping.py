"""The package for executors that don't have it installed."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp(prefix="shipped-")  # the driver's own; executors fetch the file from the driver
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "voxelloom_sources.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return query(spark, sf_dir)

    return run
