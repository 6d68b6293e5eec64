"""Gives executors this package, for task-side Python, where their import path doesn't hold it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> SparkSession:
    """Adds the package, zipped, to the application's Python files; once for each application, before functions go to tasks."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="docfields-")) / "docfields_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
