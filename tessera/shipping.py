"""Give executors this very package, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the application, once; Spark serves the archive to executors as they come up."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, f"tessera/{module.relative_to(root)}")
    context.addPyFile(str(path))
