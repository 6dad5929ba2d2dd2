"""All queries by name, and the SQL that they are checked against: those here and in the modules imported at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import series as R
from ..streaming import live
from .registry import DAILY, FLAGSHIP, HOURLY, ORACLES, ORD, PEARSON, QUERIES, SHIP, Tables, query  # noqa: F401

# ---- scans, classification, URLs

@query("SELECT event_id, date_trunc('hour', ts) - INTERVAL 1 HOUR AS hour FROM events")
def file_name_hour(t):
    return t.events.select("event_id", N.file_hour(F.concat(F.lit("pagecounts-"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".gz"))).alias("hour"))


@query("""SELECT DISTINCT event_type || '+User_' || user_id || '$norm' AS name, event_type AS project, 'User_' || user_id || '$norm' AS article, event_type || '.wikipedia.org' AS domain
  FROM events""")
def name_parts(t):
    raw = F.concat("event_type", F.lit("+User "), "user_id")
    name = S.name_canonical(S.norm_suffix(raw))
    return t.events.select(name.alias("name")).distinct().select("name", S.project_of(F.col("name")).alias("project"), S.article_of(F.col("name")).alias("article"), S.project_domain(S.project_of(F.col("name"))).alias("domain"))


@query("SELECT DISTINCT event_type AS project FROM events")
def project_list(t):
    return t.events.select(F.col("event_type").alias("project")).distinct()


@query("""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\\s\\x00]+', ' ', 'g') AS text
  FROM pages""")
def html_basic_unescape(t):
    return t.pages.select("page_id", S.text_clean(F.col("html"), entities=False).alias("text"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g') AS alias, trim(regexp_replace(lower(p_name), '[^a-z0-9'' -]', '', 'g')) AS query FROM part")
def name_to_query(t):
    return t.part.select("p_partkey", S.alias(F.col("p_name")).alias("alias"), S.to_query(F.concat(F.col("p_name"), F.lit(" (part)"))).alias("query"))


# ---- filters and sampling

@query("SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e') GROUP BY source")
def regex_search(t):
    return t.documents.where(F.col("text").rlike("(?i)licen[cs]e")).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' AND value > 40
  GROUP BY 1) SELECT g::DATE AS day, coalesce(n, 0) AS n FROM generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY) s(g)
  LEFT JOIN d ON d.day = g::DATE""")
def grep_daily_dense(t):
    d = t.events.where("event_type = 'error' and value > 40").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return R.densify(d.withColumn("k", F.lit(1)), ["k"], "day", "1 DAY", {"n": 0}).select("day", "n")


@query(f"SELECT project, article, sum(v) AS total FROM ({HOURLY}) GROUP BY ALL HAVING sum(v) >= 15")
def keep_threshold(t):
    return t.series().groupBy("project", "article").agg(F.sum("v").alias("total")).where("total >= 15")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
  WHERE n = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)""")
def first_per_user(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = t.events.where("event_type = 'click'").withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.join(t.events.where("event_type = 'error' and value > 60").select("user_id").distinct(), "user_id", "left_anti").select("user_id", "event_id")


@query("SELECT event_id, ((event_id % 65536 * 40503 + (event_id >> 16) % 2147483647 * 65599 + 97) % 2147483647 * 48271 % 2147483647) < 1073741824 AS first_half FROM events")
def halves(t):
    return t.events.select("event_id", (N.portable_hash(F.col("event_id")) < 1073741824).alias("first_half"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
  GROUP BY ALL HAVING sum(CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END + CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END) >= 1.5 * count(*)""")
def trim_for_fit(t):
    good = F.sum(F.when(F.col("l_tax") != 0, 1).otherwise(0) + F.when(F.col("l_discount") != 0, 1).otherwise(0))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), good.alias("g")).where("g >= 1.5 * n").drop("g")


# ---- aggregation

@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(t):
    return t.documents.select(F.explode(S.tokens_space(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(HOURLY)
def hourly_series(t):
    return t.series()


@query(f"SELECT project, hour, sum(v) AS total FROM ({HOURLY}) GROUP BY ALL")
def project_totals(t):
    return R.totals(t.series())


@query(f"""SELECT project || '+' || article AS name, date_trunc('month', hour)::DATE AS fragment, sum(v) AS total, 744 AS size, sum(v * (extract(day
  FROM hour) * 24 + extract(hour FROM hour))) AS weighted FROM ({HOURLY}) GROUP BY ALL""")
def month_fragments(t):
    at = F.aggregate(F.zip_with("data", F.sequence(F.lit(24), F.size("data") + 23), lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    return R.fragments(t.series(), 4).select("name", "fragment", "total", F.size("data").alias("size"), at.alias("weighted"))


for _unit in ("day", "week", "month"):

    def _resample(t, unit=_unit):
        return R.resample(t.series(), ["project"], "hour", "v", unit)

    _resample.__name__ = f"resample_{_unit}"
    query(f"SELECT project, date_trunc('{_unit}', hour)::TIMESTAMP AS hour, sum(v) AS v FROM ({HOURLY}) GROUP BY ALL")(_resample)


@query(f"SELECT project, (date_trunc('week', hour + INTERVAL 1 DAY) - INTERVAL 1 DAY)::DATE AS hour, sum(v) AS v FROM ({HOURLY}) GROUP BY ALL")
def resample_week_saturday(t):
    return R.resample(t.series(), ["project"], "hour", "v", "week-sat")


@query("SELECT event_id, user_id FROM events ORDER BY event_id")
def distinct_by_id(t):
    both = t.events.unionByName(t.events)
    return both.groupBy("event_id").agg(F.min("user_id").alias("user_id")).orderBy("event_id")


@query("""SELECT l_returnflag, max(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS peak, min(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS trough
  FROM lineitem GROUP BY 1""")
def masked_extremes(t):
    v = F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_returnflag").agg(F.max(v).alias("peak"), F.min(v).alias("trough"))


@query(f"""SELECT project, round({PEARSON.format('v', 'y')}, 6) AS r, round(pow({PEARSON.format('v', 'y')}, 2), 6) AS r2, round(sqrt(avg(pow(v - y, 2))), 4) AS rmse
  FROM ({DAILY}) JOIN (SELECT ts::DATE AS day, sum(value) / 10 AS y FROM events GROUP BY 1) USING (day) GROUP BY project""")
def correlation_errors(t):
    y = t.events.groupBy(F.to_date("ts").alias("day")).agg((F.sum("value") / 10).alias("y"))
    r = R.pearson(F.col("v"), F.col("y"))
    return t.daily().join(y, "day").groupBy("project").agg(F.round(r, 6).alias("r"), F.round(F.pow(r, 2), 6).alias("r2"), F.round(F.sqrt(F.avg(F.pow(F.col("v") - F.col("y"), 2))), 4).alias("rmse"))


@query(f"""WITH d AS ({DAILY}), a AS (SELECT project, arg_max(day, struct_pack(v := v, d := -epoch(day))) AS peak_day, max(v) AS peak FROM d
  GROUP BY 1) SELECT a.project, a.peak_day, a.peak, a.peak - b.peak AS d_peak, date_diff('day', b.peak_day, a.peak_day) AS d_days FROM a, a b
  WHERE b.project = 'click'""")
def peak_timing(t):
    p = t.daily().groupBy("project").agg(F.max(F.struct("v", (-F.unix_date("day")).alias("d"), "day")).alias("m")).select("project", F.col("m.day").alias("peak_day"), F.col("m.v").alias("peak"))
    base = p.where("project = 'click'").select(F.col("peak_day").alias("b_day"), F.col("peak").alias("b"))
    return p.crossJoin(F.broadcast(base)).select("project", "peak_day", "peak", (F.col("peak") - F.col("b")).alias("d_peak"), F.datediff("peak_day", "b_day").alias("d_days"))


@query(f"""WITH d AS ({DAILY}), y AS (SELECT day, v AS y FROM d WHERE project = 'view')
  , s AS (SELECT project, sign(v - lag(v) OVER w) AS a, sign(y - lag(y) OVER w) AS b FROM d JOIN y USING (day)
  WINDOW w AS (PARTITION BY project ORDER BY day)) SELECT project, round(avg((a = b)::INT), 6) AS hit_rate FROM s WHERE a IS NOT NULL AND b IS NOT NULL
  GROUP BY 1""")
def hit_rate(t):
    d = t.daily()
    y = d.where("project = 'view'").select("day", F.col("v").alias("y"))
    return R.hit_rate(d.join(y, "day"), ["project"], "day", "v", "y").withColumn("hit_rate", F.round("hit_rate", 6))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 2) AS q025, round(quantile_cont(o_totalprice, 0.5), 2) AS q50, round(quantile_cont(o_totalprice, 0.975), 2) AS q975, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, CASE WHEN count(*) >= 10 THEN round(avg(o_totalprice), 2) ELSE 0 END AS mean_min10
  FROM orders GROUP BY 1""")
def quantiles(t):
    q = F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = t.orders.groupBy("o_orderpriority").agg(q.alias("q"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"), F.when(F.count("*") >= 10, F.round(F.avg("o_totalprice"), 2)).otherwise(F.lit(0.0)).alias("mean_min10"))
    return g.select("o_orderpriority", F.round(F.col("q")[0], 2).alias("q025"), F.round(F.col("q")[1], 2).alias("q50"), F.round(F.col("q")[2], 2).alias("q975"), "mean", "sd", "mean_min10")


@query("WITH h AS (SELECT floor(value / 20)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1) SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cumulative FROM h")
def histogram_cumulative(t):
    h = t.events.groupBy(F.floor(F.col("value") / 20).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("cumulative", F.sum("n").over(Window.orderBy("bin")))


COUNTS = "SELECT word, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM (SELECT role, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1"


def _counters(t) -> DataFrame:
    w = t.conversations.select("role", F.explode(S.tokens_space(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") == "assistant").alias("b"))


@query(f"SELECT word, greatest(b - a, 0) AS more FROM ({COUNTS}) WHERE b > a ORDER BY more DESC, word LIMIT 20")
def counter_difference(t):
    return _counters(t).where("b > a").select("word", (F.col("b") - F.col("a")).alias("more")).orderBy(F.desc("more"), "word").limit(20)


@query(f"""SELECT round(sum(a * b)::DOUBLE / sqrt(sum(a * a)::DOUBLE * sum(b * b)::DOUBLE), 6) AS cosine, round(corr(a, b), 6) AS r, count(*) FILTER (a > 0 AND b > 0) AS shared
  FROM ({COUNTS})""")
def counter_similarity(t):
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return _counters(t).agg(F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 6).alias("cosine"), F.round(R.pearson(a, b), 6).alias("r"), F.count_if((a > 0) & (b > 0)).alias("shared"))


@query("""SELECT user_id % 10 AS grp, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS period, round(coalesce(sum(value) FILTER (event_type = 'click') / nullif(sum(value), 0), 0), 6) AS ratio
  FROM events GROUP BY ALL""")
def period_ratio(t):
    period = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "before").otherwise("after")
    part = F.sum(F.when(F.col("event_type") == "click", F.col("value")))
    return t.events.groupBy((F.col("user_id") % 10).alias("grp"), period.alias("period")).agg(F.round(F.coalesce(F.try_divide(part, F.sum("value")), F.lit(0.0)), 6).alias("ratio"))


GAINS = """WITH p AS (SELECT l_returnflag AS grp, l_linestatus AS model, sqrt(avg(pow(l_discount - 0.05, 2))) AS rmse, avg(CASE WHEN l_tax > 0.02 THEN 1.0 ELSE 0.0 END) AS hits
  FROM lineitem GROUP BY ALL) SELECT p.grp, p.model, b.rmse / nullif(p.rmse, 0) AS error_gain, (1 - b.hits) / nullif(1 - p.hits, 0) AS hit_gain FROM p JOIN p b ON b.grp = p.grp AND b.model = 'O'"""


def _gains(t) -> DataFrame:
    hits = F.avg(F.when(F.col("l_tax") > 0.02, 1.0).otherwise(0.0))
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("model"))
    p = p.agg(F.sqrt(F.avg(F.pow(F.col("l_discount") - 0.05, 2))).alias("rmse"), hits.alias("hits"))
    return R.gains(p, ["grp"], "model", "O", ["rmse"], ["hits"]).withColumnsRenamed({"rmse": "error_gain", "hits": "hit_gain"})


@query(f"SELECT grp, model, round(error_gain, 6) AS error_gain, round(hit_gain, 6) AS hit_gain FROM ({GAINS})")
def improvement_ratio(t):
    """Errors of a base model over those of others, and what similarities leave over what theirs do."""
    return _gains(t).select("grp", "model", F.round("error_gain", 6).alias("error_gain"), F.round("hit_gain", 6).alias("hit_gain"))


@query(f"SELECT model, round(min(error_gain), 6) AS low, round(median(error_gain), 6) AS middle, round(max(error_gain), 6) AS high FROM ({GAINS}) GROUP BY 1")
def improvement_summary(t):
    g = _gains(t).groupBy("model").agg(F.min("error_gain").alias("low"), F.median("error_gain").alias("middle"), F.max("error_gain").alias("high"))
    return g.select("model", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query("SELECT source, round(avg(quality), 6) AS success_rate, count(*) AS attempted FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def outcome_rates(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("success_rate"), F.count("*").alias("attempted"))


# ---- joins and alignment

@query(f"""WITH s AS ({HOURLY}), a AS (SELECT project, article, date_trunc('day', hour) AS day, sum(v) AS v FROM s GROUP BY ALL)
  , b AS (SELECT project, date_trunc('day', hour) AS day, sum(v) AS total FROM s
  GROUP BY ALL) SELECT project, article, day::TIMESTAMP AS day, round(1e6 * v / total, 4) AS norm FROM a JOIN b USING (project, day)""")
def normalised_series(t):
    s = t.series()
    a = R.resample(s, ["project", "article"], "hour", "v", "day").withColumnRenamed("hour", "day")
    b = R.resample(R.totals(s), ["project"], "hour", "total", "day").withColumnRenamed("hour", "day")
    return R.normalise(a, b, ["project", "day"]).select("project", "article", "day", F.round("norm", 4).alias("norm"))


@query(f"SELECT coalesce(a.day, b.day) AS day, coalesce(v, 0) AS v, coalesce(y, 0) AS y FROM ({SHIP}) a FULL JOIN ({ORD}) b ON a.day = b.day")
def date_union(t):
    a, b = _ship(t), _orders(t)
    return a.join(b, "day", "full").select("day", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("y", F.lit(0.0)).alias("y"))


def _ship(t) -> DataFrame:
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))


def _orders(t) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("y"))


@query(f"SELECT day, v, y, round(v / y, 6) AS ratio FROM ({SHIP}) JOIN ({ORD}) USING (day)")
def date_intersect(t):
    return _ship(t).join(_orders(t), "day").select("day", "v", "y", F.round(F.try_divide("v", "y"), 6).alias("ratio"))


@query(f"SELECT g::DATE AS day, coalesce(v, 0) AS v FROM generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) s(g) LEFT JOIN ({SHIP}) ON day = g::DATE")
def resize_bounds(t):
    return R.resize(_ship(t), "day", "v", "1996-01-01", "1996-12-31")


LAG_SQL = f"WITH d AS ({DAILY}), y AS (SELECT day, v AS y FROM d WHERE project = 'view'), k AS (SELECT unnest(range(-28, 29))::INT AS lag), m AS (SELECT (day + lag)::DATE AS day, lag, y FROM y, k) SELECT project, lag, round({PEARSON.format('v', 'y')}, 6) AS r, count(*) AS n FROM d JOIN m USING (day) GROUP BY ALL"


@query(LAG_SQL)
def lag_correlation(t):
    d = t.daily()
    y = d.where("project = 'view'").select("day", F.col("v").alias("y"))
    return R.lagged(d, y, "day", ["project"], range(-28, 29)).withColumn("r", F.round("r", 6))



# ---- windows

@query(f"""WITH d AS ({DAILY}) SELECT project, day, lag(v, 2) OVER w AS shifted, coalesce(lag(v) OVER w, v) AS persistence, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS running
  FROM d WINDOW w AS (PARTITION BY project ORDER BY day)""")
def shifts(t):
    w = Window.partitionBy("project").orderBy("day")
    d = R.persistence(t.daily(), ["project"], "day", "v")
    return d.select("project", "day", F.lag("v", 2).over(w).alias("shifted"), F.col("prediction").alias("persistence"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("SELECT now::INT AS now FROM (SELECT unnest(range(0, 96, 4)) AS now) WHERE now >= 30")
def rolling_origins(t):
    return R.schedule(t.spark, 104, 22, 8, 4)


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g
  FROM events) SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM e GROUP BY user_id, event_type, g""")
def islands(t):
    a, b = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = t.events.withColumn("g", F.row_number().over(a) - F.row_number().over(b))
    return e.groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).drop("g")


@query(f"""SELECT project, day, ntile(5) OVER (PARTITION BY project ORDER BY day) AS fold, ((row_number() OVER (PARTITION BY project ORDER BY day) - 1) // 7)::INT AS chunk
  FROM ({DAILY})""")
def folds_chunks(t):
    w = Window.partitionBy("project").orderBy("day")
    return t.daily().select("project", "day", F.ntile(5).over(w).alias("fold"), F.floor((F.row_number().over(w) - 1) / 7).cast("int").alias("chunk"))


@query(f"""WITH a AS (SELECT project, day, v, row_number() OVER (PARTITION BY project ORDER BY day) AS i
  FROM ({DAILY})) SELECT a.project, a.day AS now, b.day AS period, (b.i - a.i)::INT AS staleness, a.v AS prediction FROM a
  JOIN a b ON a.project = b.project AND b.i - a.i BETWEEN 1 AND 3""")
def staleness(t):
    a = t.daily().withColumn("i", F.row_number().over(Window.partitionBy("project").orderBy("day")))
    ahead = a.select("project", F.col("day").alias("now"), F.col("v").alias("prediction"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("staleness"), "i").withColumn("i", F.col("i") + F.col("staleness"))
    return ahead.join(a.select("project", "i", F.col("day").alias("period")), ["project", "i"]).select("project", "now", "period", "staleness", "prediction")


# ---- sorting, top k, sets

@query("""SELECT o_orderpriority, o_orderkey, o_totalprice, rank::INT AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def bounded_queue(t):
    return R.top(t.orders.where("o_totalprice is not null"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders")
def set_intersect(t):
    return t.lineitem.select(F.col("l_orderkey").alias("k")).intersect(t.orders.select("o_orderkey"))


# ---- scalar functions

@query("""SELECT c_custkey, (c_custkey > 0 AND (c_custkey & (c_custkey - 1)) = 0) AS power2, least(floor((c_acctbal + 1000) / 2200.0), 4)::INT AS bin, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS logistic, round(-2 * ln(1 - 0.95), 6) AS chi2, round(0.9 * ((c_nationkey % 7 + 1) - 1) / 6 + 0.05, 6) AS deceptive
  FROM customer""")
def scalar_math(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", N.is_power_2(F.col("c_custkey")).alias("power2"), N.consecutive(b, -1000, 10000, 5).alias("bin"), F.round(N.logistic(b / 1000), 6).alias("logistic"), F.round(N.chi2_critical(F.lit(0.95)), 6).alias("chi2"), F.round(N.deceptiveness(F.col("c_nationkey") % 7 + 1), 6).alias("deceptive"))


HASH = "list_reduce(list_prepend({0}::BIGINT, list_transform(range(1, len(n_name) + 1), lambda i: ascii(n_name[i])::BIGINT)), lambda h, b: {1})"


@query(f"""SELECT n_name, {HASH.format(2166136261, 'xor(h, b) * 16777619 % 4294967296')} AS fnv, {HASH.format(5381, 'xor(h * 33 % 4294967296, b)')} AS djb, ({HASH.format(2166136261, 'xor(h, b) * 16777619 % 4294967296')} % 240)::INT AS shard
  FROM nation""")
def hashes(t):
    return t.nation.select("n_name", N.fnv1a_32(F.col("n_name")).alias("fnv"), N.djb2(F.col("n_name")).alias("djb"), N.shard(F.col("n_name"), 240).alias("shard"))


@query("""SELECT event_id, ts::DATE AS day, date_trunc('month', ts)::DATE AS month, ((extract(day FROM ts) - 1) * 24 + extract(hour
  FROM ts))::INT AS offset_h, (extract(day
  FROM last_day(ts::DATE)) * 24)::INT AS month_h, (date_diff('day', DATE '1970-01-01', ts::DATE) + 719163) * 24 + extract(hour FROM ts) AS ordinal
  FROM events""")
def date_functions(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.to_date(ts).alias("day"), N.month_of(ts).alias("month"), N.hour_offset(ts).alias("offset_h"), N.hours_in_month(ts).alias("month_h"), N.ordinal_hour(ts).alias("ordinal"))


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS parsed FROM events")
def tweet_timestamps(t):
    raw = F.date_format("ts", "'Mon' MMM dd HH:mm:ss '+0000' yyyy")
    return t.events.select("event_id", N.tweet_time(raw).alias("parsed"))


GEO = "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey * 14.0 - 170 AS x1, a.n_nationkey * 6.0 - 70 AS y1, b.n_nationkey * 14.0 - 170 AS x2, b.n_nationkey * 6.0 - 70 AS y2 FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey"


@query(f"""SELECT a, b, round(2 * 6371.009 * asin(sqrt(least(1.0, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))), 4) AS km
  FROM ({GEO})""")
def geodesic_sphere(t):
    return _geo(t).select("a", "b", F.round(N.sphere_km(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), 4).alias("km"))


def _geo(t) -> DataFrame:
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") * 14.0 - 170).alias("x"), (F.col("n_nationkey") * 6.0 - 70).alias("y"))
    a, b = n.toDF("a", "x1", "y1"), n.toDF("b", "x2", "y2")
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


@query(None)
def geodesic_ellipsoid(t):
    return _geo(t).select("a", "b", F.round(N.ellipsoid_km(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), 4).alias("km"))


@query("""SELECT n_nationkey, round(radians(n_nationkey * 14.0 - 170) * 6371.009, 4) AS x, round(1.25 * ln(tan(pi() / 4 + 0.4 * radians(n_nationkey * 6.0 - 70))) * 6371.009, 4) AS y
  FROM nation WHERE abs(n_nationkey * 6.0 - 70) < 89.99""")
def miller_projection(t):
    lon, lat = F.col("n_nationkey") * 14.0 - 170, F.col("n_nationkey") * 6.0 - 70
    x, y = N.miller(lon, lat)
    return t.nation.where(N.in_bounds(lat)).select("n_nationkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("""SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') AS stem, printf('%d:%02d:%02d', length(html) // 3600, length(html) // 60 % 60, length(html) % 60) AS clock
  FROM pages""")
def formatting(t):
    return t.pages.select("page_id", S.without_ext(F.col("url")).alias("stem"), S.seconds_text(F.length("html")).alias("clock"))


# ---- composites, models, graphs

@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
  FROM lineitem GROUP BY 1""")
def ols_one_feature(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


def _points(t) -> DataFrame:
    return t.embeddings.select(F.col("label").cast("string").alias("token"), (F.col("embedding")[0].cast("double") * 10).alias("lon"), (F.col("embedding")[1].cast("double") * 10).alias("lat"))


@query("SELECT r_name AS root, n_name AS article FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region")
def link_graph(t):
    links = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("root"), F.col("n_name").alias("article"))
    return links.union(t.region.select("r_name", F.col("r_name"))).distinct()


# ---- streams, run to the end of what is there

def _stream(t) -> DataFrame:
    """The events, written to a folder of the shared one, as a stream of files."""
    path = shared.path(t.spark, "stream-in")
    t.events.write.parquet(path)
    return t.spark.readStream.schema(t.events.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    path = shared.path(df.sparkSession, name)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(ts)
  FROM events) GROUP BY ALL""")
def stream_hourly(t):
    return _finish(live.hourly_counts(_stream(t), "ts", ["event_type"]), "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events")
def stream_distinct(t):
    return _finish(live.distinct(_stream(t), "ts", "event_id").select("event_id", "user_id"), "distinct")


@query("SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_months(t):
    path = shared.path(t.spark, "months")
    counts = _stream(t).select(N.month_of(F.col("ts")).alias("month"), "event_type")

    def batch(df, k, merge=live.merge_months(path, "month")):
        merge(df.groupBy("month", "event_type").agg(F.count("*").alias("n")), k)

    counts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return live.read_months(t.spark, path, ["month", "event_type"])


from . import inputs, modelling, search, stores, texts  # noqa: E402, F401 (they add their queries)
