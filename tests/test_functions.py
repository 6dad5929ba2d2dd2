"""Hand-worked cases of functions, models and files."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.functions import numbers as N
from wavelark.functions import strings as S
from wavelark.operators import models as M
from wavelark.operators import series as R
from wavelark.sources import files


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_strings(spark):
    r = one(spark, S.url_decode(F.lit("a%20b_c+d%ZZ")), S.url_decode(F.lit("L%C3%A1tra_x+y")), S.url_encode(F.lit("Lá b*~/")), S.name_canonical(F.lit("en+Foo bar$norm")), S.text_clean(F.lit("null")), S.text_clean(F.lit("a &amp; b \t\n c &eacute;")), S.to_query(F.lit("Café_(place)")))
    assert list(r) == ["a%20b c+d%ZZ", "Látra x+y", "L%C3%A1_b%2A~/", "en+Foo_bar$norm", None, "a & b c é", "cafe"]


def test_tokens(spark):
    r = one(spark, S.ngrams(S.tokens_space(F.lit(" A b  c ")), 2), S.ngrams(S.tokens_space(F.lit(None).cast("string")), 2), S.tokens_script(F.lit("abcДеf ไทย 1")), S.tokens_word(F.lit("Don't stop-it 3x")))
    assert list(r) == [["a", "b", "c", "a b", "b c"], [], ["abc", "де", "f"], ["don't", "stop-it", "3x"]]
    with pytest.raises(ValueError):
        S.ngrams(F.array(), 0)


def test_script_tokens(spark):
    """As its SQL where lower case leaves the range of a filter (the Kelvin sign, A with stroke), and texts of a million letters or signs."""
    import time

    import duckdb

    from wavelark.plans import catalog, texts

    rows = [(1, "\u212a \u03a9\u03bc\u03ad\u03b3\u03b1 \u1ec7"), (2, "\u023a \u0434\u0430"), (3, "plain text"), (5, "caf\u00e9 \u2014 42"), (7, None)]

    class Few:
        documents = spark.createDataFrame(rows, "doc_id long, text string")

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, texts.script_tokens(Few).collect())) == sorted(con.execute(catalog.ORACLES["script_tokens"]).fetchall())
    long = spark.range(1).select(F.concat(F.repeat(F.lit("\u044f"), 1000000), F.repeat(F.lit(" 1;"), 1000000), F.repeat(F.lit("z"), 1000000)).alias("t")).cache()
    long.count()
    began = time.time()
    assert [len(x) for x in long.select(S.tokens_script(F.col("t"))).first()[0]] == [1000000, 1000000] and time.time() - began < 20


def test_hashes_and_dates(spark):
    r = one(spark, N.fnv1a_32(F.lit("")), N.fnv1a_32(F.lit("a")), N.file_hour(F.lit("pagecounts-20140101-010000.gz")).cast("string"), N.hours_in_month(F.lit("2015-02-03").cast("date")), N.tweet_time(F.lit("Wed Oct 31 12:00:01 +0000 2012")).cast("string"), N.week_saturday(F.lit("2024-01-06").cast("timestamp")).cast("string"))
    assert list(r) == [2166136261, 0xE40C292C, "2014-01-01 00:00:00", 672, "2012-10-31 12:00:01", "2023-12-31"]


def test_distance():
    d = N.vincenty(np.array([-86.67, 0.0]), np.array([36.12, 0.0]), np.array([-118.40, 0.0]), np.array([33.94, 0.0]))
    assert abs(d[0] - 2892.777) < 0.01 and d[1] == 0
    assert abs(N.ring_area(np.array([-180, 180, 180, -180.0]), np.array([0, 0, 1e-9, 1e-9]))) < 1


def test_pearson_defaults(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, None), ("k", 3.0, 2.0), ("k", 4.0, 5.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("s", 1.0, 2.0)], "k string, a double, b double")
    got = {r.k: r.r for r in df.groupBy("k").agg(R.pearson(F.col("a"), F.col("b")).alias("r")).collect()}
    assert abs(got["k"] - np.corrcoef([1, 3, 4], [1, 2, 5])[0, 1]) < 1e-12 and got["c"] == 0 and got["s"] == 0


def test_fragments(spark):
    df = spark.createDataFrame([("f", "1", "2015-01-01 00:00:00", 11.0), ("f", "1", "2015-01-01 02:00:00", 22.0), ("f", "1", "2015-02-28 23:00:00", 44.0), ("d", "2", "2015-02-01 00:00:00", 1.0)], "project string, article string, hour string, v double").withColumn("hour", F.to_timestamp("hour"))
    rows = {(r.name, str(r.fragment)): r for r in R.fragments(df, 4, 20).collect()}
    assert set(rows) == {("f+1", "2015-01-01"), ("f+1", "2015-02-01")}
    assert len(rows["f+1", "2015-01-01"].data) == 744 and rows["f+1", "2015-02-01"].data[671] == 44
    back = R.fetch(R.fragments(df, 4), "f+1").where("v <> 0").count()
    assert back == 3 and R.drop_latest_only(R.fragments(df, 4)).select("name").distinct().count() == 1


def test_page_counts(spark, tmp_path):
    with gzip.open(tmp_path / "pagecounts-20150101-010000.gz", "wt") as f:
        f.write("en Main_Page 3 10\nen File:X 1 1\na a a a\nde Foo%20b 2 5\n")
    (tmp_path / "pagecounts-20150101-020000.tmp").write_text("en Main_Page 9 9\n")
    rows = sorted((r.project, r.url, r["count"], str(r.hour)) for r in files.page_counts(spark, str(tmp_path)).collect())
    assert rows == [("de", "Foo%20b", 2, "2015-01-01 00:00:00"), ("en", "Main_Page", 3, "2015-01-01 00:00:00")]


def test_tweets(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id":1,"created_at":"Wed Oct 31 12:00:01 +0000 2012","text":"a &lt; b","coordinates":{"type":"Point","coordinates":[1.5,2.5]},"user":{"screen_name":"u","lang":"en"}}\n{"delete":{}}\n2F\n\n')
    r = files.tweets_json(spark, str(tmp_path / "t.json")).collect()
    assert len(r) == 1 and (r[0].text, r[0].lon, r[0].geom_src) == ("a < b", 1.5, "co")
    (tmp_path / "g.json").write_text('x\n{"a":\n1}\n{"b":2}\n')
    assert sorted(x.json for x in files.json_glued(spark, str(tmp_path / "g.json")).collect()) == ['{"a":1}', '{"b":2}']
    files.write_tsv(spark.createDataFrame([(1, None, "x y")], "a int, b string, c string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1\t\tx y"


def test_intervals_and_interpolation(spark):
    df = spark.createDataFrame([("a", "2012-10-28", 0.1), ("a", "2012-10-30", 1.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    assert [(str(r.day), r.v) for r in R.intervals(df, ["k"], "d", "v").orderBy("day").collect()] == [("2012-10-28", 0.05), ("2012-10-29", 0.05), ("2012-10-30", 1.0)]
    df = spark.createDataFrame([("a", "2020-01-0%d" % k, v) for k, v in enumerate([None, 1.0, None, 3.0, None], 1)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    assert [r.v for r in R.interpolate(df, ["k"], "d", "v").orderBy("d").collect()] == [0, 1, 2, 3, 0]


def test_densify(spark):
    """Against a join with the whole axis: repeated, null and uneven times, null keys, keys without times, values of null, one and two steps, hours and days."""
    rows = [("a", 1, 3, 1.0), ("a", 1, 3, 2.0), ("a", 1, 5, 3.0), ("a", 2, 9, None), ("b", 1, 4, 4.0), ("b", 1, None, 5.0), ("c", 1, None, 6.0), ("d", None, 4, 7.0), ("d", None, 7, 8.0), (None, 1, 12, 9.0), ("e", 1, 12, 1.5), ("f", 1, 3, 2.5), ("f", 1, 12, 3.5)]
    base = spark.createDataFrame(rows, "k string, m int, t int, v double")
    day, hour = F.date_add(F.lit("2024-02-25").cast("date"), F.col("t")), F.timestamp_seconds(F.col("t") * 3600 + 1709000000 // 3600 * 3600)
    for time, step in ((day, "1 DAY"), (day, "2 DAYS"), (day, "1 WEEK"), (day, "1 MONTH"), (hour, "1 HOUR"), (hour, "3 HOURS"), (hour, "90 MINUTES"), (hour, "1 DAY")):
        df = base.select("k", "m", time.alias("t"), "v")
        for per_key in (True, False):
            span = [F.min("t").alias("lo"), F.max("t").alias("hi")]
            axis = df.groupBy("k", "m").agg(*span) if per_key else df.select("k", "m").distinct().crossJoin(df.agg(*span))
            want = axis.select("k", "m", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("t")).join(df, ["k", "m", "t"], "left").withColumn("v", F.coalesce("v", F.lit(-1.0)))
            got = R.densify(df, ["k", "m"], "t", step, {"v": -1.0}, per_key)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (step, per_key)
    assert R.densify(base.where("k = 'none'").select("k", day.alias("t"), "v"), ["k"], "t", "1 DAY", {"v": 0.0}, False).isEmpty()


def test_densify_moves_few_rows(spark):
    """No exchange is above the rows that densify makes, nor under the totals' join."""
    from wavelark.plans import search
    from wavelark.plans.registry import Tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search.article_access(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("explode(")].splitlines()
    assert not any(" Exchange " in line or "SortMergeJoin" in line for line in above)


def test_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = 1 + 2 * x[:, 0] + 0.5 * x[:, 2]
    assert np.allclose(M.ridge(x, y, 1e-9), [1, 2, 0, 0.5], atol=1e-6)
    assert np.allclose(M.elastic_net(x, y, 1e-6), [1, 2, 0, 0.5], atol=1e-3)
    assert M.elastic_net(x, -y, 0.1)[1] == 0
    assert M.cross_validate(x, y, np.array([1e-4, 10.0])) == 1e-4


def test_mixture():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((0, 0), 0.1, (40, 2)), rng.normal((5, 5), 0.1, (40, 2))])
    found = M.gmm(x)
    assert abs(sum(w for w, _, _ in found) - 1) < 1e-9
    assert len(M.gmm(np.array([[1.0, 2.0]]))) == 1


def test_streams(spark, tmp_path):
    from wavelark.streaming import live

    batch = spark.createDataFrame([("2024-01-01", "a", 2), ("2024-02-01", "a", 1)], "month string, k string, n long")
    save = live.merge_months(str(tmp_path / "m"), "month")
    save(batch, 0)
    save(batch, 0)
    save(batch.where("n = 2"), 1)
    assert sorted((str(r.month), r.n) for r in live.read_months(spark, str(tmp_path / "m"), ["month", "k"]).collect()) == [("2024-01-01", 4), ("2024-02-01", 1)]
