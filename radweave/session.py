"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, unless their PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    on_path = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or app in _shipped:
        return spark
    archive = Path(tempfile.mkdtemp(prefix="radweave-")) / "radweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / "radweave").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    return spark
