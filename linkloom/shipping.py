"""The package for executors: Python workers import kernels by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Add this package to the executors' Python path, once for a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_linkloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="linkloom-")) / "linkloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._linkloom_shipped = True
