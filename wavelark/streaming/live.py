"""Incremental versions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared


def hourly_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window; windows close ``late`` after the newest event."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *keys, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key with gaps under ``gap``."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(stream: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def merge_months(path: str, month: str):
    """A ``foreachBatch`` function that stores a batch's counts by month; a repeated batch replaces its own files only."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month, "batch").parquet(path)

    return merge


def read_months(spark, path: str, keys: list[str]) -> DataFrame:
    """Counts ``n`` by key over all batches stored by ``merge_months``."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


class MonthStore:
    """Counts by month that come in updates, as Parquet: a folder for each month and in it one for each version, of which the last that was written whole counts.

    An update of a new month is written as it is; one of a month that is there is added to it, and the sum is the next version. When a month is closed, counts under
    ``threshold`` go: new months are filtered as they are written, others once their sums are whole. An update that breaks off changes nothing. Give an update a ``number``
    to have it once only: one whose number a month has already is left out (``foreachBatch`` may repeat a batch).
    """

    def __init__(self, spark, path: str, keys: list[str], threshold: float):
        self.spark, self.path, self.keys, self.threshold = spark, path.rstrip("/"), keys, threshold

    def _version(self, month: str) -> tuple[int, int] | None:
        """The last version of a month, and one more than the number of the update that made it (0 if that had none)."""
        done = []
        for n in shared.children(self.spark, f"{self.path}/{month}"):
            k, number = (int(x) for x in n[1:].split("-u"))
            if shared.whole(self.spark, f"{self.path}/{month}/{n}"):
                done.append((k, number))
        return max(done, default=None)

    def _table(self, month: str, version: tuple[int, int]) -> str:
        return f"{self.path}/{month}/v{version[0]}-u{version[1]}"

    def strategy(self, month: str, closed: bool) -> int:
        """0 add, 1 write, 2 add and prune, 3 write what is large enough."""
        return 2 * closed + (self._version(month) is None)

    def update(self, counts: DataFrame, closed: bool, number: int = -1) -> dict[str, int]:
        """Merge rows (month, keys, n); returns the strategy of each month."""
        done = {}
        for month in sorted(str(r.month) for r in counts.select("month").distinct().collect()):
            now = self._version(month)
            if now and 0 <= number < now[1]:
                continue
            done[month] = 2 * closed + (now is None)
            rows = counts.where(F.col("month") == F.lit(month).cast("date")).select("month", *self.keys, F.col("n").cast("long").alias("n"))
            if now:
                rows = rows.unionByName(self.spark.read.parquet(self._table(month, now))).groupBy("month", *self.keys).agg(F.sum("n").alias("n"))
            if closed:
                rows = rows.where(F.col("n") >= self.threshold)
            rows.write.mode("overwrite").parquet(self._table(month, (now[0] + 1 if now else 0, number + 1)))
        return done

    def read(self) -> DataFrame:
        months = shared.children(self.spark, self.path)
        return self.spark.read.parquet(*[self._table(m, self._version(m)) for m in months if self._version(m)])


def month_closed(hours: DataFrame, hour: str) -> DataFrame:
    """Rows (month, closed): a month is closed once its last hour is there."""
    from ..functions import numbers as N

    by = hours.groupBy(N.month_of(F.col(hour)).alias("month")).agg(F.max(hour).alias("last"))
    return by.select("month", (F.date_trunc("hour", "last") == F.expr("timestamp(last_day(month)) + INTERVAL 23 HOURS")).alias("closed"))


def heartbeat(say, first: int = 1):
    """A query listener that calls ``say`` with the rows so far after 1, 2, 4, ... batches."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Heartbeat(StreamingQueryListener):
        def __init__(self):
            self.rows = self.batches = 0
            self.next = first

        def onQueryStarted(self, event): ...

        def onQueryProgress(self, event):
            self.rows += event.progress.numInputRows
            self.batches += 1
            if self.batches >= self.next:
                self.next *= 2
                say(self.rows)

        def onQueryIdle(self, event): ...

        def onQueryTerminated(self, event): ...

    return Heartbeat()
