"""Queries on input files and sinks, over lines and file names made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..sources import files
from .registry import query

NAMES = """SELECT DISTINCT CASE WHEN extract(hour FROM ts) = 5 THEN 'notes.txt' ELSE 'pagecounts-' || strftime(CASE WHEN extract(hour FROM ts) = 7 THEN ts - INTERVAL 60 DAY ELSE ts END, '%Y%m%d-%H0000') || '.gz' END AS name
  FROM events"""


@query(f"""WITH n AS (SELECT name, date_trunc('month', strptime(nullif(regexp_extract(name, '([0-9]{{8}}-[0-9]{{6}})', 1), ''), '%Y%m%d-%H%M%S') - INTERVAL 1 HOUR)::DATE AS month FROM ({NAMES}))
  SELECT name, month, coalesce(month = (SELECT month FROM n WHERE name = (SELECT max(name) FROM n WHERE month IS NOT NULL)), false) AS valid FROM n""")
def input_validation(t):
    """Which files have a time, and one in the month of the last file."""
    ts = F.when(F.hour("ts") == 7, F.col("ts") - F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts"))
    stamp = F.concat(F.lit("pagecounts-"), F.date_format(F.date_trunc("hour", ts), "yyyyMMdd-HHmmss"), F.lit(".gz"))
    names = t.events.select(F.when(F.hour("ts") == 5, "notes.txt").otherwise(stamp).alias("name")).distinct()
    return files.validated(names, "name")


@query("""WITH l AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row, lpad(user_id::VARCHAR, 7, '0') AS line FROM events),
  f AS (SELECT *, line < lag(line) OVER (PARTITION BY file ORDER BY row) AS falls FROM l)
  SELECT file, row, line FROM f WHERE row < coalesce((SELECT min(row) FROM f g WHERE g.file = f.file AND g.falls), 1000000000)""")
def sorted_prefix(t):
    """Lines of each file up to the first that is out of order."""
    from pyspark.sql.window import Window

    rows = t.events.select(F.col("event_type").alias("file"), F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("row"), F.lpad(F.col("user_id").cast("string"), 7, "0").alias("line"))
    return files.sorted_prefix(rows, "file", "row", "line")


PROJECT = "CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de.m' WHEN 2 THEN 'fr.a.b' ELSE 'zh_x' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_full_match({PROJECT}, '[a-z]+(\\.[a-z]+)?') ELSE regexp_full_match({PROJECT}, '[a-z.]+') END AS kept FROM events""")
def project_cutover(t):
    """Projects have at most one dot in files up to 2015-01-15 and any number later."""
    stamp = F.when(F.col("event_id") % 3 == 0, F.lit("2015-01-15 00:00:00")).otherwise(F.lit("2015-01-15 01:00:00")).cast("timestamp")
    return t.events.select("event_id", files.project_ok(F.expr(PROJECT), stamp).alias("kept"))


@query("SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def tsv_round_trip(t):
    """Tab-separated files, one folder a kind, written and read again."""
    path = shared.path(t.spark, "tsv")
    files.write_tsv(t.events.select("event_id", "user_id", F.col("event_type").alias("kind")), path, "kind")
    rows = t.spark.read.csv(path, sep="\t", schema="event_id long, user_id long, kind string")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT n_regionkey, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (n_nationkey * 5 - 60) || ',' || (n_nationkey * 3 - 30) ||
  ']},"properties":{"name":"' || n_name || '"}}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation GROUP BY 1""")
def geojson(t):
    rows = t.nation.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * 5 - 60).alias("lon"), (F.col("n_nationkey") * 3 - 30).alias("lat"), F.col("n_name").alias("name"))
    return files.geojson(rows, ["n_regionkey"], "n_nationkey", F.col("lon"), F.col("lat"), ["name"])


@query("""SELECT o_orderpriority AS test, o_orderstatus AS token, count(*) AS n, printf('%.4g', avg(o_totalprice)) AS mean FROM orders GROUP BY ALL""")
def summary_tables(t):
    """A summary for each pair of test and token, as a sheet on disk reads."""
    from ..functions import strings as S

    path = shared.path(t.spark, "summary")
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("test"), F.col("o_orderstatus").alias("token")).agg(F.count("*").alias("n"), S.g4_text(F.avg("o_totalprice")).alias("mean"))
    files.write_tsv(rows, path)
    return t.spark.read.csv(path, sep="\t", schema="test string, token string, n long, mean string")


@query("""SELECT i.month, i.event_type, i.n, i.n >= 20 AS kept FROM (SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS n FROM events GROUP BY ALL) i WHERE i.n >= 20""")
def monthly_update(t):
    """Counts that come in two updates of an open month and one that closes it, which removes small ones."""
    from ..streaming import live

    s = live.MonthStore(t.spark, shared.path(t.spark, "month-store"), ["event_type"], 20)
    days = F.dayofmonth("ts")
    for low, high, closed in ((1, 10, False), (11, 20, False), (21, 31, True)):
        part = t.events.where(days.between(low, high)).groupBy(F.trunc("ts", "month").alias("month"), "event_type").agg(F.count("*").alias("n"))
        s.update(part, closed)
    return s.read().select("month", "event_type", "n", (F.col("n") >= 20).alias("kept"))
