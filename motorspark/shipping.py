"""Sends this package to the executors of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_motorspark_shipped", False):
        return
    home = Path(__file__).resolve().parent
    made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / home.name), "zip", home.parent, home.name)
    context.addPyFile(made)
    context._motorspark_shipped = True
