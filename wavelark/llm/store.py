"""Tables written to the folder that all executors share.

A written table cuts lineage: once committed it survives the loss of any
executor, and is read back like every other Parquet table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    return shared.folder(spark)


ROWS = 2000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: unless the session has a number of its own, at most ROWS of them go to Python at once, as a batch is held twice outside the heap."""
    if spark.conf.get(_KEY) == "10000":
        spark.conf.set(_KEY, str(ROWS))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/wavelark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wavelark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``save`` that nothing reads any more."""
    path = getattr(df, "_wavelark_path", None)
    if path:
        shared.delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores ahead until no column of ``df`` has it (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_ids(df: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id", most: int = 500_000) -> DataFrame:
    """Join of wide rows with a narrow table by id columns, which is broadcast if it has at most ``most`` rows.

    Beyond that the join is Spark's to plan; the result is the same.
    """
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)
