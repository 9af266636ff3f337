"""Making the package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless PYTHONPATH already names its folder."""
    top = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="fathom-ship-"), "fathom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
