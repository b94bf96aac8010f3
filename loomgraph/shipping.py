"""Sends the package to the executors, so that Python workers find it wherever they start."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the context's Python files, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_loomgraph_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._loomgraph_shipped = True
    return spark
