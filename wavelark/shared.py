"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset, as in tests on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wavelark_folder", None)
    if not path:
        path = spark._wavelark_folder = "file://" + tempfile.mkdtemp(prefix="wavelark-")
    return path.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/wavelark/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, where: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, where: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def whole(spark: SparkSession, where: str) -> bool:
    """Whether a table was written to its end."""
    return "_SUCCESS" in children(spark, where)
