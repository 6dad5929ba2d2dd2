"""Queries that count, align, correlate and search series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import mapreduce
from ..operators import series as R
from .registry import DAILY, HOURLY, ORD, PEARSON, SERIES_DAY, query, series_day

GRAMS = """SELECT day, ngram, count(*) AS n FROM (WITH w AS (SELECT (DATE '2024-01-01' + (conv_id % 10)::INT)::DATE AS day, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t
  FROM conversations) SELECT day, unnest(t) AS ngram FROM w UNION ALL SELECT day, t[i] || ' ' || t[i + 1] FROM w, unnest(range(1, len(t))) r(i)) GROUP BY ALL"""
GRAM_TOTALS = f"SELECT day, sum(n)::DOUBLE AS total FROM ({GRAMS}) GROUP BY 1"


def grams(t) -> DataFrame:
    """Counts (ngram, day, n) of one and two words; conversations stand on ten days by their ids."""
    # tokens are a column of their own, as every n-gram refers to them
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 10).cast("int"))
    toks = t.conversations.select(day.alias("day"), S.tokens_space(F.col("text")).alias("toks"))
    return toks.select("day", F.explode(S.ngrams(F.col("toks"), 2)).alias("ngram")).groupBy("ngram", "day").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({GRAMS}), k AS (SELECT ngram, min(day) AS lo, max(day) AS hi, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING sum(n) >= 10),
  a AS (SELECT ngram, total, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM k)
  SELECT a.ngram, a.day, coalesce(c.n, 0) AS n, a.total FROM a LEFT JOIN c ON c.ngram = a.ngram AND c.day = a.day""")
def ngram_daily(t):
    """N-grams of at least ten occurrences, zeros between their first and last days, with totals."""
    c = grams(t)
    some = c.groupBy("ngram").agg(F.sum("n").alias("total"), F.min("day").alias("lo"), F.max("day").alias("hi")).where("total >= 10")
    axis = some.select("ngram", "total", F.explode(F.sequence("lo", "hi")).alias("day"))
    return axis.join(c, ["ngram", "day"], "left").select("ngram", "day", F.coalesce("n", F.lit(0)).alias("n"), "total")


MASK = f"(SELECT median(total) * 0.9 FROM ({GRAM_TOTALS}))"


@query(f"""WITH c AS ({GRAMS}), k AS (SELECT ngram FROM c GROUP BY 1 HAVING sum(n) >= 10), y AS ({GRAM_TOTALS})
  SELECT k.ngram, y.day, CASE WHEN y.total >= {MASK} THEN round(1e6 * coalesce(c.n, 0) / y.total, 4) END AS ppm FROM k CROSS JOIN y LEFT JOIN c ON c.ngram = k.ngram AND c.day = y.day""")
def ngram_search(t):
    """Parts a million of the day's n-grams; days with less than nine tenths of the median total are masked."""
    c = grams(t)
    totals = c.groupBy("day").agg(F.sum("n").cast("double").alias("total"))
    enough = totals.agg((F.median("total") * 0.9).alias("m"))
    kept = c.join(c.groupBy("ngram").agg(F.sum("n").alias("k")).where("k >= 10").select("ngram"), "ngram", "left_semi")
    rows = R.parts_per(kept, totals.crossJoin(F.broadcast(enough)).select("day", "total", "m").select("day", F.when(F.col("total") >= F.col("m"), F.col("total")).alias("total")), ["ngram"], "day")
    return rows.withColumn("ppm", F.round("ppm", 4))


SEARCH = f"""WITH c AS ({GRAMS}), k AS (SELECT ngram FROM c GROUP BY 1 HAVING sum(n) >= 10), y AS (SELECT day, total, row_number() OVER (ORDER BY day) % 4 * 1.0 AS y FROM ({GRAM_TOTALS})),
  d AS (SELECT k.ngram, y.day, 1e6 * coalesce(c.n, 0) / y.total AS v, y.y FROM k CROSS JOIN y LEFT JOIN c ON c.ngram = k.ngram AND c.day = y.day)
  SELECT ngram, round({PEARSON.format('v', 'y')}, 5) AS r, round(max(v), 3) AS peak, round(min(v), 3) AS trough FROM d GROUP BY 1"""


@query(f"SELECT * FROM ({SEARCH}) WHERE peak >= 1000 AND abs(r) >= 0.5")
def ngram_similarity(t):
    """N-grams whose parts a million go with a target that counts days in fours, with peak and similarity large enough."""
    c = grams(t)
    totals = c.groupBy("day").agg(F.sum("n").cast("double").alias("total"))
    kept = c.join(c.groupBy("ngram").agg(F.sum("n").alias("k")).where("k >= 10").select("ngram"), "ngram", "left_semi")
    v = kept.join(totals, "day").select("ngram", "day", (F.col("n") * 1e6 / F.col("total")).alias("v"))
    # the days are few: one row each
    target = totals.select("day", F.lit("fours").alias("target"), (F.row_number().over(Window.orderBy("day")) % 4).cast("double").alias("y"))
    found = R.correlate_sparse(v, target, "day", ["ngram"]).drop("target").withColumns({"r": F.round("r", 5), "peak": F.round("peak", 3), "trough": F.round("trough", 3)})
    return R.similar(found, 1000, 0.5)


RANKED = f"""WITH s AS ({SERIES_DAY}), y AS (SELECT day, project AS target, v AS y FROM ({DAILY})), n AS (SELECT DISTINCT name FROM s), a AS (SELECT DISTINCT day FROM y),
  d AS (SELECT n.name, a.day, coalesce(v, 0) AS v FROM n CROSS JOIN a LEFT JOIN s ON s.name = n.name AND s.day = a.day),
  r AS (SELECT target, name, round({PEARSON.format('v', 'y')}, 6) AS r, max(v) AS peak, min(v) AS trough FROM d JOIN y USING (day) GROUP BY ALL)
  SELECT target, name, r, peak, trough, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, name) AS rank FROM r)"""


def ranked(t) -> DataFrame:
    y = t.daily().select("day", F.col("project").alias("target"), F.col("v").alias("y"))
    return R.correlate_sparse(series_day(t).drop("project"), y, "day", ["name"]).withColumn("r", F.round("r", 6))


@query(f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def candidate_search(t):
    """For every target, the ten of all series that correlate best with it."""
    return R.top(ranked(t), ["target"], [F.abs("r").desc(), F.asc("name")], 10).select("target", "name", "r", "peak", "trough", "rank")


@query(f"SELECT target, (rank - 1)::INT AS place, name, r FROM ({RANKED}) WHERE rank <= 25")
def results_by_key(t):
    """A file of results for each target, in order, as they are read back."""
    best = R.top(ranked(t), ["target"], [F.abs("r").desc(), F.asc("name")], 25)
    path = shared.path(t.spark, "results")
    best.repartition("target").sortWithinPartitions("target", "rank").select("target", "name", "r").write.partitionBy("target").parquet(path)
    return t.spark.read.parquet(path).select("target", F.col("_metadata.row_index").cast("int").alias("place"), "name", "r")


@query(f"SELECT name, rank FROM ({RANKED}) WHERE target = 'click' AND (rank IN (1, 3, 4) OR rank > (SELECT max(rank) FROM ({RANKED})) - 2)")
def result_slices(t):
    rows = ranked(t).where("target = 'click'")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.abs("r").desc(), "name")))
    return R.select_slices(rows, ["target"], [F.asc("rank")], "0,2:4,-2:").select("name", "rank")


@query("SELECT s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS lo, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) AS hi FROM supplier) WHERE lo <= 5 OR hi <= 5")
def slices_both_ends(t):
    s = t.supplier.select("s_suppkey", "s_acctbal")
    return s.orderBy("s_acctbal", "s_suppkey").limit(5).union(s.orderBy(F.desc("s_acctbal"), F.desc("s_suppkey")).limit(5)).distinct()


@query("""WITH m AS (SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY 1) SELECT o.o_orderstatus, max(o_orderkey) AS o_orderkey, max(o_custkey) AS o_custkey,
  max(o_totalprice) AS best FROM orders o JOIN m ON o.o_orderstatus = m.o_orderstatus AND o_totalprice = m GROUP BY 1""")
def best_per_group(t):
    m = t.orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("best"))
    both = t.orders.join(m, "o_orderstatus").where("o_totalprice = best")
    return both.groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_custkey").alias("o_custkey"), F.max("best").alias("best"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 5) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def column_normalise(t):
    s = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return t.orders.join(s, "o_orderpriority").select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("s"), 5).alias("z"))


HASHED = "((event_id % 65536 * 40503 + (event_id >> 16) % 2147483647 * 65599 + 97) % 2147483647 * 48271 % 2147483647)"


@query(f"SELECT event_id, user_id FROM events ORDER BY {HASHED}, event_id LIMIT 100")
def sample_exact(t):
    return R.sample_hash(t.events, "event_id", n=100).select("event_id", "user_id")


@query(f"SELECT event_id FROM events WHERE {HASHED} % 1000003 < 250000")
def sample_fraction(t):
    return R.sample_hash(t.events, "event_id", fraction=0.25).select("event_id")


@query(f"""WITH w AS (SELECT DISTINCT project, article FROM ({HOURLY})), h AS (SELECT unnest(generate_series((SELECT min(date_trunc('hour', ts)) FROM events), (SELECT max(date_trunc('hour', ts)) FROM events),
  INTERVAL 1 HOUR)) AS hour), y AS (SELECT project, hour, sum(v) AS total FROM ({HOURLY}) GROUP BY ALL)
  SELECT w.project, w.article, h.hour::TIMESTAMP AS hour, coalesce(s.v, 0) AS v, coalesce(y.total, 0) AS total FROM w CROSS JOIN h LEFT JOIN ({HOURLY}) s ON s.project = w.project AND s.article = w.article
  AND s.hour = h.hour LEFT JOIN y ON y.project = w.project AND y.hour = h.hour""")
def article_access(t):
    """Every series at every hour, 0 where it has none, beside its project's total."""
    s = t.series()
    dense = R.densify(s, ["project", "article"], "hour", "1 HOUR", {"v": 0.0}, per_key=False)
    # one row for each hour of a project, so that the dense rows stay where they are
    return dense.join(F.broadcast(R.totals(s)), ["project", "hour"], "left").select("project", "article", "hour", "v", F.coalesce("total", F.lit(0.0)).alias("total"))


@query(f"""SELECT n.name, a.day FROM (SELECT DISTINCT name FROM ({SERIES_DAY})) n CROSS JOIN (SELECT DISTINCT day FROM ({SERIES_DAY})) a
  LEFT JOIN ({SERIES_DAY}) s ON s.name = n.name AND s.day = a.day WHERE s.name IS NULL""")
def set_missing(t):
    """What of all names on all days isn't there. The days are few."""
    s = series_day(t).select("name", "day")
    return s.select("name").distinct().crossJoin(F.broadcast(s.select("day").distinct())).join(s, ["name", "day"], "left_anti")


CUSTOM = "SELECT o_custkey, o_orderdate::DATE AS day, count(*)::DOUBLE AS y FROM orders GROUP BY ALL"


@query(f"""WITH o AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY o_custkey ORDER BY day), day + 1) AS nxt FROM ({CUSTOM}) WHERE o_custkey IS NOT NULL AND day IS NOT NULL)
  SELECT date_trunc('month', day)::DATE AS month, round(sum(y), 4) AS y, count(*) AS days FROM (SELECT unnest(generate_series(day, nxt - 1, INTERVAL 1 DAY))::DATE AS day, y / (nxt - day) AS y FROM o) GROUP BY 1""")
def interval_expansion(t):
    """Each customer's orders spread evenly over the days to the next one, summed by month."""
    o = t.orders.where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("y"))
    rows = R.intervals(o, ["o_custkey"], "day", "y")
    return rows.groupBy(N.month_of(F.col("day")).alias("month")).agg(F.round(F.sum("y"), 4).alias("y"), F.count("*").alias("days"))


@query(f"""WITH n AS (SELECT DISTINCT name FROM ({SERIES_DAY})), x AS (SELECT DISTINCT day FROM ({SERIES_DAY})),
  a AS (SELECT n.name, x.day, epoch(x.day) AS t, v FROM n CROSS JOIN x LEFT JOIN ({SERIES_DAY}) s ON s.name = n.name AND s.day = x.day),
  b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER f AS v1,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1 FROM a WINDOW p AS (PARTITION BY name ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY name ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT name, day, round(coalesce(v, v0 + (v1 - v0) * (t - t0) / (t1 - t0), 0), 5) AS v FROM b""")
def interpolation(t):
    """Days without events as missing values of each series."""
    s = series_day(t).drop("project")
    dense = R.densify(s, ["name"], "day", "1 DAY", {}, per_key=False)
    return R.interpolate(dense, ["name"], "day", "v").select("name", "day", F.round("v", 5).alias("v"))


PERIODS = [("before", "2024-01-01", "2024-01-08"), ("early", "2024-01-08", "2024-01-11"), ("late", "2024-01-11", "2024-01-29"), ("gap", "2025-01-01", "2025-02-01")]
PERIODS_SQL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)


@query(f"""WITH p AS (SELECT * FROM (VALUES {PERIODS_SQL}) v(period, lo, hi)), w AS (SELECT DISTINCT name, project FROM ({SERIES_DAY})),
  a AS (SELECT name, period, sum(v) AS v FROM ({SERIES_DAY}) JOIN p ON day >= lo AND day < hi GROUP BY ALL), b AS (SELECT project, period, sum(v) AS total FROM ({DAILY}) JOIN p ON day >= lo AND day < hi GROUP BY ALL)
  SELECT w.name, p.period, round(coalesce(coalesce(a.v, 0) / nullif(b.total, 0), 0), 6) AS ratio FROM w CROSS JOIN p LEFT JOIN a ON a.name = w.name AND a.period = p.period
  LEFT JOIN b ON b.project = w.project AND b.period = p.period""")
def interval_ratios(t):
    """Each series' share of its project in irregular periods, 0 where the project has nothing. The periods are given, one row each."""
    p = t.spark.createDataFrame(PERIODS, "period string, lo string, hi string").select("period", F.explode(F.sequence(F.to_date("lo"), F.date_sub(F.to_date("hi"), 1))).alias("day"))
    s = series_day(t)
    a = s.join(F.broadcast(p), "day").groupBy("name", "period").agg(F.sum("v").alias("v"))
    b = t.daily().join(F.broadcast(p), "day").groupBy("project", "period").agg(F.sum("v").alias("total"))
    axis = s.select("name", "project").distinct().crossJoin(F.broadcast(p.select("period").distinct()))
    rows = axis.join(a, ["name", "period"], "left").join(b, ["project", "period"], "left")
    ratio = F.coalesce(F.try_divide(F.coalesce("v", F.lit(0.0)), F.nullif("total", F.lit(0.0))), F.lit(0.0))
    return rows.select("name", "period", F.round(ratio, 6).alias("ratio"))


SHIFTED = f"SELECT project, (day + 3)::DATE AS day, v FROM ({DAILY})"
TRUTH = "SELECT event_type AS project, ts::DATE AS day, sum(value) AS y FROM events WHERE value > 150 GROUP BY ALL"


@query(f"SELECT t.project, t.day, s.v, round(t.y, 4) AS y FROM ({TRUTH}) t LEFT JOIN ({SHIFTED}) s ON s.project = t.project AND s.day = t.day")
def truth_alignment(t):
    """Counts moved three days later on the dates of a thinner truth."""
    y = t.events.where("value > 150").groupBy(F.col("event_type").alias("project"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    return R.align(t.daily(), y, ["project"], "day", 3).select("project", "day", "v", F.round("y", 4).alias("y"))


@query(f"SELECT s.project, count(*) AS n, round(sqrt(avg(pow(s.v - t.y, 2))), 4) AS rmse FROM ({TRUTH}) t JOIN ({SHIFTED}) s ON s.project = t.project AND s.day = t.day GROUP BY 1")
def aligned_error(t):
    y = t.events.where("value > 150").groupBy(F.col("event_type").alias("project"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    both = R.align(t.daily(), y, ["project"], "day", 3, "inner")
    return both.groupBy("project").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("v") - F.col("y"), 2))), 4).alias("rmse"))


POSITIONS = f"SELECT project, day, v, row_number() OVER (PARTITION BY project ORDER BY day) - 1 AS position FROM ({DAILY})"


@query(f"""SELECT b.day, max(a.v) FILTER (a.position = 9) AS "9", max(a.v) FILTER (a.position = 14) AS "14", max(a.v) FILTER (a.position = 19) AS "19" FROM ({POSITIONS}) a JOIN ({POSITIONS}) b
  ON a.project = b.project AND b.position > a.position AND b.position <= a.position + 4 WHERE a.project = 'click' AND a.position IN (9, 14, 19) GROUP BY 1""")
def predictions_side_by_side(t):
    """The last value as the prediction of the next four days, a column for each time of prediction."""
    rows = t.daily().where("project = 'click'").withColumn("position", F.row_number().over(Window.partitionBy("project").orderBy("day")) - 1)
    made = rows.where("position IN (9, 14, 19)").select(F.col("position").alias("now"), "v", F.explode(F.sequence(F.col("position") + 1, F.col("position") + 4)).alias("position"))
    return R.side_by_side(made.join(rows.select("position", "day"), "position"), "day", "now", [9, 14, 19], "v")


@query(f"SELECT project, x.now, count(*) AS rows, sum(v) AS total, min(day) AS first_day FROM ({POSITIONS}) p JOIN (SELECT unnest([7, 14, 21])::INT AS now) x ON position >= x.now - 7 AND position < x.now GROUP BY ALL")
def training_window(t):
    nows = t.spark.createDataFrame([(7,), (14,), (21,)], "now int")
    rows = R.training_window(t.daily(), ["project"], "day", nows, 7)
    return rows.groupBy("project", "now").agg(F.count("*").alias("rows"), F.sum("v").alias("total"), F.min("day").alias("first_day"))


@query("""SELECT s AS train_start, s + INTERVAL 7 DAY AS train_end, s + INTERVAL 7 DAY + INTERVAL 12 HOUR AS test_start, s + INTERVAL 8 DAY + INTERVAL 12 HOUR AS test_end
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 36 HOUR)) AS s) WHERE s + INTERVAL 8 DAY + INTERVAL 12 HOUR < TIMESTAMP '2024-01-30'""")
def test_windows(t):
    return R.test_schedule(t.spark, "2024-01-01", "2024-01-30", "7 DAYS", "12 HOURS", "1 DAY", "36 HOURS")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_tax), 4) AS l_tax_sum, round(sum(l_quantity) / count(*), 5) AS l_quantity_mean,
  round(sum(l_tax) / count(*), 5) AS l_tax_mean FROM lineitem GROUP BY 1""")
def metrics_mean(t):
    m = R.metrics_mean(t.lineitem, ["l_returnflag"], ["l_quantity", "l_tax"])
    places = {"l_quantity_sum": 2, "l_tax_sum": 4, "l_quantity_mean": 5, "l_tax_mean": 5}
    return m.withColumns({c: F.round(c, k) for c, k in places.items()})


@query("""SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey <= 1)""")
def relevance_filter(t):
    """Customers within two steps (nation, region) of one of the roots, regions 0 and 1."""
    near = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1).alias("distance"))
    return t.customer.join(near.where("distance <= 2"), "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("""SELECT event_id, round(radians(value % 360 - 180) * 6371.009 / 1000, 6) + 0.0 AS x, round(1.25 * ln(tan(pi() / 4 + 0.4 * radians(user_id % 170 - 85))) * 6371.009 / 1000, 6) + 0.0 AS y
  FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09'""")
def spatial_query(t):
    """Points of a time range in Miller's projection, in units of 1000 km."""
    rows = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-05 06:00:00' AND ts < TIMESTAMP_NTZ '2024-01-09 00:00:00'")
    x, y = N.miller(F.col("value") % 360 - 180, (F.col("user_id") % 170 - 85).cast("double"), 1000.0)
    return rows.select("event_id", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"))


@query("""SELECT event_id, strptime(iso, '%Y-%m-%dT%H:%M:%S')::TIMESTAMP AS parsed, ts::DATE::TIMESTAMP AS midnight, extract(day FROM ts) = 1 AND ts = date_trunc('day', ts) AS opens_month,
  date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS days, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN ts < TIMESTAMP '2024-01-21' THEN 'test' END AS season
  FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events)""")
def iso_times(t):
    ts = F.col("ts")
    spaced = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    season = N.season(F.to_date(ts), {"train": ("2024-01-01", "2024-01-10"), "test": ("2024-01-11", "2024-01-20")})
    return t.events.select("event_id", N.iso_time(spaced).alias("parsed"), N.iso_time(F.date_format(ts, "yyyy-MM-dd")).alias("midnight"), N.opens_month(ts).alias("opens_month"),
                           N.days_diff(F.lit("2024-01-01").cast("date"), F.to_date(ts)).alias("days"), season.alias("season"))


@query(f"""SELECT name, first_day, last_day, first_day = lo AND last_day = hi AS equal, first_day >= lo AND last_day <= hi AS within FROM (SELECT name, min(day) AS first_day, max(day) AS last_day
  FROM ({SERIES_DAY}) GROUP BY 1) CROSS JOIN (SELECT min(day) AS lo, max(day) AS hi FROM ({SERIES_DAY}) WHERE project = 'click')""")
def bounds_tests(t):
    s = series_day(t)
    own = s.groupBy("name").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    all_ = s.where("project = 'click'").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    equal, within = N.bounds("first_day", "last_day", "lo", "hi")
    return own.crossJoin(F.broadcast(all_)).select("name", "first_day", "last_day", equal.alias("equal"), within.alias("within"))


@query("""SELECT c_custkey, round(exp(b - m), 6) AS scaled, round(m + 1 - b, 6) AS turned, round(1 / (1 + b), 6) AS inverse FROM (SELECT c_custkey, c_acctbal / 1000 + 1 AS b,
  max(c_acctbal / 1000 + 1) OVER (PARTITION BY c_nationkey) AS m FROM customer) WHERE 1 + b <> 0""")
def weight_scales(t):
    c = t.customer.withColumn("b", F.col("c_acctbal") / 1000 + 1)
    scaled, turned = N.scaled_weights(F.col("b"), "c_nationkey")
    return c.withColumns({"scaled": F.round(scaled, 6), "turned": F.round(turned, 6)}).where("1 + b <> 0").select("c_custkey", "scaled", "turned", F.round(N.inverse(F.col("b")), 6).alias("inverse"))


@query("SELECT word AS key, count(*) * 3 AS value FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def job_word_count(t):
    """A user's map-reduce job, named by text."""
    job = mapreduce.by_name("WordCount")(**mapreduce.arguments("factor=3"))
    return mapreduce.run(t.conversations.select("text"), job)


@query("""SELECT o_orderpriority AS key, rank::INT AS rank, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rank FROM orders) WHERE rank <= 7""")
def job_largest(t):
    """Bounded queues merged by a reducer."""
    return mapreduce.run(t.orders.select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("value")), mapreduce.by_name("wavelark.operators.mapreduce.Largest")(k=7))


@query("""SELECT project, k, string_agg(v::VARCHAR, '+' ORDER BY v) AS v FROM (SELECT event_type AS project, strftime(ts, '%Y-%m-%d') AS k, user_id AS v FROM events WHERE value > 200) GROUP BY ALL""")
def merged_maps(t):
    """Maps of lists merged key by key, lists appended."""
    halves = [t.events.where(F.col("value").between(lo, hi) & (F.col("value") > 200)) for lo, hi in ((200, 260), (260.0000001, 1e9))]
    maps = [h.groupBy(F.col("event_type").alias("project"), F.date_format("ts", "yyyy-MM-dd").alias("k")).agg(F.collect_list("user_id").alias("v")) for h in halves]
    maps = [m.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(c)) for m, c in zip(maps, "ab")]
    both = maps[0].join(maps[1], "project", "full")
    return both.select("project", F.explode(S.merge_maps(F.col("a"), F.col("b"))).alias("k", "v")).withColumn("v", F.concat_ws("+", F.sort_array("v").cast("array<string>")))


@query("""WITH d AS (SELECT (DATE '2024-01-01' + (conv_id % 10)::INT * 2)::DATE AS day, count(*) AS n FROM conversations WHERE regexp_matches(text, '(?i)\\bth[a-z]*ing\\b') GROUP BY 1)
  SELECT g::DATE AS day, coalesce(n, 0) AS n FROM generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY) s(g) LEFT JOIN d ON d.day = g::DATE""")
def grep_days(t):
    """Texts that match an expression by day (every other day has some), zeros between the first and the last."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 10 * 2).cast("int"))
    d = t.conversations.where(F.col("text").rlike(r"(?i)\bth[a-z]*ing\b")).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return R.densify(d.withColumn("k", F.lit(1)), ["k"], "day", "1 DAY", {"n": 0}).select("day", "n")


PAGES = "SELECT event_type AS project, 'P' || user_id AS url, date_trunc('hour', ts) AS hour, floor(value)::BIGINT AS count FROM events"


@query(f"""WITH l AS ({PAGES}), a AS (SELECT project, url AS article, hour, max(count)::DOUBLE AS v FROM l GROUP BY ALL), p AS (SELECT project, hour, sum(count)::DOUBLE AS total FROM l GROUP BY ALL)
  SELECT a.project, a.article, a.hour, a.v, p.total FROM a JOIN p ON p.project = a.project AND p.hour = a.hour""")
def page_vectors(t):
    """Articles' counts at an hour (of repeated lines the largest) beside their project's total of all lines."""
    lines = t.events.select(F.col("event_type").alias("project"), F.concat(F.lit("P"), "user_id").alias("url"), F.date_trunc("hour", "ts").alias("hour"), F.floor("value").alias("count"))
    articles, totals = R.hourly_pages(lines)
    return articles.join(totals, ["project", "hour"]).select("project", "article", "hour", "v", "total")


@query("""SELECT o_custkey, CASE WHEN count(*) >= 3 THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 5) END AS r FROM (SELECT o_custkey, o_totalprice AS a,
  (o_orderkey % 5)::DOUBLE AS b FROM orders) GROUP BY 1""")
def pearson_undefined(t):
    """Correlations that stay null where they aren't defined."""
    o = t.orders.select("o_custkey", F.col("o_totalprice").alias("a"), (F.col("o_orderkey") % 5).cast("double").alias("b"))
    return o.groupBy("o_custkey").agg(F.round(R.pearson(F.col("a"), F.col("b"), default=None), 5).alias("r"))


@query("""SELECT day, n, round(100 * 3 * (0.5 + date_diff('day', DATE '2024-01-01', day) / 30.0 * 0.5), 4) AS expected, n >= 0.5 * 100 * 3 * (0.5 + date_diff('day', DATE '2024-01-01', day) / 30.0 * 0.5) AS enough
  FROM (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE value > 35 GROUP BY 1)""")
def enough_data(t):
    """Days with at least half of the count that is expected of them, by a line through two dates."""
    d = t.events.where("value > 35").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    e = N.expected_count(F.col("day"), [("2024-01-01", 0.5), ("2024-01-31", 1.0)], 3.0)
    return d.select("day", "n", F.round(e, 4).alias("expected"), (F.col("n") >= 0.5 * e).alias("enough"))


@query("""SELECT n_nationkey, n.n_name || ' (' || r_name || ')' AS article, trim(regexp_replace(replace(regexp_replace(lower(replace(n.n_name, '_', ' ')), '[^a-z0-9'' -]', '', 'g'), 'nation', ''), '\\s+', ' ', 'g')) AS query
  FROM nation n JOIN region ON n_regionkey = r_regionkey""")
def article_queries(t):
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    article = F.concat("n_name", F.lit(" ("), "r_name", F.lit(")"))
    return both.select("n_nationkey", article.alias("article"), S.to_query(article, phrases=["nation"]).alias("query"))
