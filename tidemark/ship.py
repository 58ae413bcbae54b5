"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as an archive to the session's Python path, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    staged = shutil.copytree(root, os.path.join(folder, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, root.name), "zip", os.path.dirname(staged))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
