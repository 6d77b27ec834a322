"""Sends the package to the Python workers, so that a session need not have been started from its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file to the application, once."""
    context = spark.sparkContext
    if getattr(context, "_isovec_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="isovec-"), "isovec.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)  # the driver serves it; executors fetch their copies
    context._isovec_shipped = True
