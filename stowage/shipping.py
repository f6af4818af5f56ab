"""Taking this package to the executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to what Spark sends to its Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_has_stowage", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="stowage-")), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    sc.addPyFile(path)
    sc._has_stowage = True
