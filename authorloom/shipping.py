"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as staging:
        shutil.copytree(here, f"{staging}/src/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{os.path.basename(here)}", "zip", f"{staging}/src")
    context.addPyFile(made)
    _done.add(context.applicationId)
