"""Giving the executors this package."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application: functions that run there are found by name."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        d = tempfile.mkdtemp()  # it stays: Spark serves it to executors that start later, too
        spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/{root.name}-{app}", "zip", root.parent, root.name))
        _shipped.add(app)
