"""Sending this package to the executors' Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_veilscan_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="veilscan"), "veilscan_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, dirs, names in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("veilscan", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._veilscan_shipped = True
