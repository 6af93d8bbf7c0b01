"""Makes this package importable in Python workers, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    if top.is_dir():  # else it already came as an archive
        target = os.path.join(tempfile.mkdtemp(prefix="varsift-"), "varsift_package.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, os.path.join("varsift", source.relative_to(top)))
        context.addPyFile(target)
    _shipped.add(context.applicationId)
