"""Sends this package to the executors, once for each Spark context."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve the package's source to every executor through Spark, so that functions can be unpickled there.

    The archive is made in the driver's own temporary folder; Spark's file
    server hands it out, so executors need no shared folder and no installation.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{home.name}_source.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(home.rglob("*.py")):
            archive.write(file, file.relative_to(home.parent))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
