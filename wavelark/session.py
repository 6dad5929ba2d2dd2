"""Making the package available to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application (they need not have it installed)."""
    sc = spark.sparkContext
    if getattr(sc, "_wavelark_shipped", None) == sc.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(), "wavelark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("wavelark", os.path.relpath(full, _ROOT)))
    sc.addPyFile(path)
    sc._wavelark_shipped = sc.applicationId
