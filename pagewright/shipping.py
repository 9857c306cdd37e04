"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to every executor, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, folders, files in os.walk(_PACKAGE):
            folders[:] = [x for x in folders if x != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._pagewright_shipped = True
