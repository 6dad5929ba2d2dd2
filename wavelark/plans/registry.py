"""The registry of queries, the tables they read, and SQL that several share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as R

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "candidate_search"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def series(self) -> DataFrame:
        return R.hourly(self.events, "event_type", "user_id", "ts")

    def daily(self) -> DataFrame:
        return self.events.groupBy(F.col("event_type").alias("project"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("v"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HOURLY = "SELECT event_type AS project, user_id::VARCHAR AS article, date_trunc('hour', ts) AS hour, count(*)::DOUBLE AS v FROM events GROUP BY ALL"
DAILY = "SELECT event_type AS project, ts::DATE AS day, count(*)::DOUBLE AS v FROM events GROUP BY ALL"
SHIP = "SELECT l_shipdate::DATE AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1"
ORD = "SELECT o_orderdate::DATE AS day, count(*)::DOUBLE AS y FROM orders GROUP BY 1"
PEARSON = "CASE WHEN count(*) >= 3 THEN coalesce(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 0) ELSE 0 END"
SERIES_DAY = "SELECT event_type || '+' || user_id AS name, event_type AS project, ts::DATE AS day, count(*)::DOUBLE AS v FROM events GROUP BY ALL"


def series_day(t: Tables) -> DataFrame:
    """Daily counts (name, project, day, v) of every series; days without events have no row."""
    name = F.concat_ws("+", "event_type", F.col("user_id").cast("string"))
    return t.events.groupBy(name.alias("name"), F.col("event_type").alias("project"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("v"))
