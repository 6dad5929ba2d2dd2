"""A store of month fragments: Parquet partitioned by month and shard, so that a name is looked up in its own shard only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import numbers as N

SCHEMA = "name string, total double, data array<double>, fragment date, shard int"


def shard_of(name: str, shards: int) -> int:
    """The same as ``numbers.shard``, for names on the driver."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % shards


class SeriesStore:
    """Series by name, month and shard. Removing rows writes a new generation beside the old one, which readers of the old one can finish."""

    def __init__(self, spark: SparkSession, path: str, shards: int):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def _generations(self) -> list[int]:
        names = [n for n in shared.children(self.spark, self.path) if n[:1] == "g" and n[1:].isdigit()]
        # the first grows month by month; later ones count once they are written whole
        return sorted(int(n[1:]) for n in names if n == "g0" or shared.whole(self.spark, f"{self.path}/{n}"))

    def _write(self, frags: DataFrame, generation: int, mode: str = "dynamic") -> None:
        rows = frags.select("name", "total", "data", "fragment", "shard").repartition("fragment", "shard").sortWithinPartitions("fragment", "shard", "name")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("fragment", "shard").parquet(f"{self.path}/g{generation}")

    def save(self, frags: DataFrame, threshold: float = 0.0) -> None:
        """Store fragments with a total of at least ``threshold``; of the stored months only those in ``frags`` are replaced."""
        self._write(frags.where(F.col("total") >= threshold), (self._generations() or [0])[-1])

    def fragments(self) -> DataFrame:
        now = self._generations()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/g{now[-1]}") if now else self.spark.createDataFrame([], SCHEMA)

    def is_empty(self) -> bool:
        return self.fragments().isEmpty()

    def months(self) -> DataFrame:
        return self.fragments().select("fragment").distinct()

    def named(self, names: Iterable[str]) -> DataFrame:
        """Stored fragments of the names; only their shards are read."""
        names = sorted(set(names))
        return self.fragments().where(F.col("shard").isin(sorted({shard_of(n, self.shards) for n in names})) & F.col("name").isin(names))

    def _dense(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """A fragment of every stored month for each name of ``keys``, zeros where there is none. Months are few: one row each."""
        axis = keys.crossJoin(F.broadcast(self.months()))
        zeros = F.array_repeat(F.lit(0.0), N.hours_in_month(F.col("fragment")))
        out = axis.join(rows.select("name", "fragment", "total", "data"), ["name", "fragment"], "left")
        return out.select("name", "fragment", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("data", zeros).alias("data"))

    def fetch(self, names: Iterable[str], latest_only: bool = True) -> DataFrame:
        """Rows (name, fragment, total, data) of the names that are stored, absent months as zeros; without ``latest_only`` not those whose only month is the latest."""
        rows = self.named(names)
        if not latest_only:
            rows = rows.join(self._latest_only(rows), "name", "left_anti")
        return self._dense(rows, rows.select("name").distinct())

    def fetch_or_create(self, names: Iterable[str]) -> DataFrame:
        """As ``fetch``, with zeros for names that aren't stored."""
        keys = self.spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
        return self._dense(self.named(names), keys)

    def missing(self, names: Iterable[str]) -> DataFrame:
        """The names that aren't stored."""
        keys = self.spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
        return keys.join(self.named(names).select("name"), "name", "left_anti")

    def _latest_only(self, rows: DataFrame) -> DataFrame:
        latest = self.months().agg(F.max("fragment").alias("latest"))
        by_name = rows.groupBy("name").agg(F.count("*").alias("n"), F.max("fragment").alias("fragment"))
        return by_name.join(F.broadcast(latest), F.col("fragment") == F.col("latest")).where("n = 1").select("name")

    def scan(self, shards: Iterable[int] | None = None, latest_only: bool = True) -> DataFrame:
        """All stored fragments, or those of some shards; sorted by name within a shard's files."""
        rows = self.fragments()
        if shards is not None:
            rows = rows.where(F.col("shard").isin(sorted(set(shards))))
        return rows if latest_only else rows.join(self._latest_only(rows), "name", "left_anti")

    def _replace(self, rows: DataFrame) -> None:
        self._write(rows, self._generations()[-1] + 1, "static")

    def prune(self, threshold: float, keep_totals: bool = True) -> None:
        """Remove fragments with a total under the threshold; those of bare projects (denominators) stay unless ``keep_totals`` is false."""
        ok = F.col("total") >= threshold
        self._replace(self.fragments().where(ok | ~F.contains("name", F.lit("+")) if keep_totals else ok))

    def delete(self, names: Iterable[str]) -> None:
        self._replace(self.fragments().where(~F.col("name").isin(sorted(set(names)))))

    def listing(self) -> DataFrame:
        """Rows (name, total) with whole totals over all months."""
        return self.fragments().groupBy("name").agg(F.floor(F.sum("total")).alias("total"))

    def dump(self) -> DataFrame:
        """Rows (fragment, shard, name, hour, value) of all values but zeros."""
        return self.fragments().select("fragment", "shard", "name", F.posexplode("data").alias("hour", "value")).where("value <> 0")
