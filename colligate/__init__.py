"""Co-occurrence analytics on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_colligate_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "colligate.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for p in sorted(top.rglob("*.py")):
            packed.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._colligate_shipped = True
