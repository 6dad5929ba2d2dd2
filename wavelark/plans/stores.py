"""Queries on month fragments and the series store. The events cover one month, so two thirds of the users also have theirs a month earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import strings as S
from ..operators import series as R
from ..operators.store import SeriesStore
from .registry import DAILY, SERIES_DAY, query, series_day

SHARDS = 16
TWO = """SELECT event_type || '+' || user_id AS name, hour, count(*)::DOUBLE AS v FROM (SELECT event_type, user_id, date_trunc('hour', ts) AS hour FROM events
  UNION ALL SELECT event_type, user_id, date_trunc('hour', ts) - INTERVAL 31 DAY FROM events WHERE user_id % 3 <> 0) GROUP BY ALL"""
MONTHS = f"SELECT name, date_trunc('month', hour)::DATE AS fragment, sum(v) AS total FROM ({TWO}) GROUP BY ALL"
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::BIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"
ONLY = f"SELECT name FROM ({MONTHS}) GROUP BY 1 HAVING count(*) = 1 AND max(fragment) = (SELECT max(fragment) FROM ({MONTHS}))"
WANTED = ["click+1", "click+2", "view+3", "view+5", "error+6", "none+1", "click+1000000"]
WANTED_SQL = ", ".join(f"('{n}')" for n in WANTED)


def two_months(t) -> DataFrame:
    earlier = F.when(F.col("user_id") % 3 != 0, F.array("ts", F.col("ts") - F.expr("INTERVAL 31 DAYS"))).otherwise(F.array("ts"))
    return R.hourly(t.events.select("event_type", "user_id", F.explode(earlier).alias("ts")), "event_type", "user_id", "ts")


def stored(t) -> SeriesStore:
    s = SeriesStore(t.spark, shared.path(t.spark, "series"), SHARDS)
    s.save(R.fragments(two_months(t), SHARDS))
    return s


@query(f"SELECT name, fragment, total FROM ({MONTHS}) WHERE name NOT IN ({ONLY})")
def latest_month_only(t):
    return R.drop_latest_only(R.fragments(two_months(t), SHARDS)).select("name", "fragment", "total")


def _fetch_sql(names: str) -> str:
    return f"""SELECT n.name, m.fragment, coalesce(s.total, 0) AS total, (extract(day FROM last_day(m.fragment)) * 24)::INT AS size FROM ({names}) n
      CROSS JOIN (SELECT DISTINCT fragment FROM ({MONTHS})) m LEFT JOIN ({MONTHS}) s ON s.name = n.name AND s.fragment = m.fragment"""


@query(_fetch_sql(f"SELECT DISTINCT name FROM ({MONTHS}) WHERE name IN (SELECT * FROM (VALUES {WANTED_SQL}))"))
def store_fetch(t):
    return stored(t).fetch(WANTED).select("name", "fragment", "total", F.size("data").alias("size"))


@query(_fetch_sql(f"SELECT DISTINCT name FROM ({MONTHS}) WHERE name IN (SELECT * FROM (VALUES {WANTED_SQL})) AND name NOT IN ({ONLY})"))
def store_fetch_older(t):
    return stored(t).fetch(WANTED, latest_only=False).select("name", "fragment", "total", F.size("data").alias("size"))


@query(_fetch_sql(f"SELECT * FROM (VALUES {WANTED_SQL}) v(name)"))
def store_fetch_or_create(t):
    return stored(t).fetch_or_create(WANTED).select("name", "fragment", "total", F.size("data").alias("size"))


@query(f"SELECT name FROM (VALUES {WANTED_SQL}) v(name) WHERE name NOT IN (SELECT name FROM ({MONTHS}))")
def store_missing(t):
    return stored(t).missing(WANTED)


@query(f"SELECT name, fragment, ({FNV} % {SHARDS})::INT AS shard, total FROM ({MONTHS}) WHERE {FNV} % {SHARDS} IN (0, 3, 7) AND name NOT IN ({ONLY})")
def store_scan(t):
    return stored(t).scan([0, 3, 7], latest_only=False).select("name", "fragment", "shard", "total")


@query(f"SELECT name, floor(sum(total))::BIGINT AS total FROM ({MONTHS}) GROUP BY 1")
def store_listing(t):
    return stored(t).listing()


@query(f"SELECT name, sum(total) AS total, count(*) AS months FROM ({MONTHS}) WHERE total >= 14 AND name NOT IN (SELECT * FROM (VALUES {WANTED_SQL})) GROUP BY 1")
def store_prune_delete(t):
    s = stored(t)
    s.prune(14)
    s.delete(WANTED)
    return s.fragments().groupBy("name").agg(F.sum("total").alias("total"), F.count("*").alias("months"))


@query(f"""SELECT date_trunc('month', hour)::DATE AS fragment, ({FNV} % {SHARDS})::INT AS shard, name, ((extract(day FROM hour) - 1) * 24 + extract(hour FROM hour))::INT AS hour, v AS value
  FROM ({TWO})""")
def store_dump(t):
    return stored(t).dump()


@query(f"SELECT (SELECT count(*) FROM ({MONTHS})) = 0 AS stored_empty, true AS new_empty, (SELECT count(DISTINCT fragment) FROM ({MONTHS})) AS months")
def store_emptiness(t):
    s, new = stored(t), SeriesStore(t.spark, shared.path(t.spark, "series"), SHARDS)
    return t.spark.createDataFrame([(s.is_empty(), new.is_empty(), s.months().count())], "stored_empty boolean, new_empty boolean, months long")


@query(f"""SELECT day, coalesce(printf('%.4g', sum(v) FILTER (project = 'click') / 7), '') AS click, coalesce(printf('%.4g', sum(v) FILTER (project = 'view') * 1e-6), '') AS "view",
  coalesce(printf('%.4g', sum(v) FILTER (project = 'error') * 12345.678), '') AS error FROM ({DAILY}) GROUP BY day""")
def wide_pivot(t):
    p = t.daily().groupBy("day").pivot("project", ["click", "view", "error"]).agg(F.sum("v"))
    return p.select("day", S.g4_text(F.col("click") / 7).alias("click"), S.g4_text(F.col("view") * 1e-6).alias("view"), S.g4_text(F.col("error") * 12345.678).alias("error"))


AXIS = "date_diff('day', (SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events)) + 1"


@query(f"SELECT name, round(1 - count(*) / ({AXIS}), 6) AS zeros FROM ({SERIES_DAY}) GROUP BY 1 HAVING 1 - count(*) / ({AXIS}) <= 2 / 3")
def zero_fraction_filter(t):
    axis = t.events.agg((F.datediff(F.max("ts"), F.min("ts")) + 1).alias("n")).first().n
    return R.zero_fraction(series_day(t), ["name"], "day", "v", axis, 2 / 3).withColumn("zeros", F.round("zeros", 6))


CHUNKS = f"SELECT name, (date_diff('day', (SELECT min(ts)::DATE FROM events), day) // 5)::INT AS chunk, v FROM ({SERIES_DAY})"


@query(f"SELECT name, chunk, sum(v) AS total FROM ({CHUNKS}) GROUP BY ALL HAVING max(abs(v)) > 0")
def nonzero_chunks(t):
    """Runs of five days of the dense series but those that are all zero."""
    dense = R.densify(series_day(t).drop("project"), ["name"], "day", "1 DAY", {"v": 0.0}, per_key=False)
    low = t.events.agg(F.to_date(F.min("ts")).alias("low"))
    rows = dense.crossJoin(F.broadcast(low)).withColumn("chunk", F.floor(F.datediff("day", "low") / 5).cast("int"))
    return rows.groupBy("name", "chunk").agg(F.sum("v").alias("total"), F.max(F.abs("v")).alias("most")).where("most > 0").drop("most")


@query("""WITH e AS (SELECT ts::DATE AS day, event_id, CASE WHEN value > 250 THEN value - 250 END AS lon FROM events WHERE event_type = 'signup' AND value > 200),
  g AS (SELECT g::DATE AS day FROM generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY) s(g)),
  c AS (SELECT day, count(*) AS count, count(lon) AS count_geotag, min(event_id) AS min_id, max(event_id) AS max_id FROM e GROUP BY 1)
  SELECT g.day, count, count_geotag, min_id, max_id, round(100.0 * count_geotag / count, 4) AS geotag_pct, coalesce(count, 0) >= 3 AS enough FROM g LEFT JOIN c ON c.day = g.day""")
def day_metadata(t):
    """Counts of a thin stream by day, with null on the days that it lacks."""
    e = t.events.where("event_type = 'signup' AND value > 200").select(F.to_date("ts").alias("day"), "event_id", F.expr("CASE WHEN value > 250 THEN value - 250 END").alias("lon"))
    c = e.groupBy("day").agg(F.count("*").alias("count"), F.count("lon").alias("count_geotag"), F.min("event_id").alias("min_id"), F.max("event_id").alias("max_id"))
    d = R.densify(c.withColumn("k", F.lit(1)), ["k"], "day", "1 DAY", {}).drop("k")
    return d.withColumns({"geotag_pct": F.round(F.col("count_geotag") * 100.0 / F.col("count"), 4), "enough": F.coalesce("count", F.lit(0)) >= 3})
