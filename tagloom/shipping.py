"""Sending this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors of ``spark``, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tagloom-")  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tagloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
