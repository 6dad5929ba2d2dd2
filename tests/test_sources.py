"""Files, sinks, streams, stores and jobs."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.functions import numbers as N
from wavelark.functions import strings as S
from wavelark.operators import mapreduce
from wavelark.operators import series as R
from wavelark.operators.store import SeriesStore, shard_of
from wavelark.sources import files
from wavelark.streaming import live


def test_target_sheet(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,halloween,_skip,s@ndy\n2012-10-28,0.1,x,\n2012-10-30,,y,1\n")
    got = {(r.target, str(r.day)): r.y for r in files.target_sheet(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("halloween", "2012-10-28"): 0.1, ("halloween", "2012-10-30"): None, ("s@ndy", "2012-10-28"): None, ("s@ndy", "2012-10-30"): 1.0}


def test_graph_labels(spark, tmp_path):
    (tmp_path / "Flu.gml").write_text('graph [\n node [\n  id 1\n  label "Influenza"\n ]\n node [\n  label "Virus (biology)"\n ]\n]\n')
    assert sorted((r.root, r.article) for r in files.graph_labels(spark, str(tmp_path)).collect()) == [("Flu", "Influenza"), ("Flu", "Virus (biology)")]


def test_tweets_tsv(spark, tmp_path):
    row = ["262200000000000001", "2012-10-28T00:00:01Z", "a \"quoted\" text", "me", "", "en", "", "", "1.5", "-2.5", "co"]
    (tmp_path / "2012-10-28.all.tsv").write_text("\t".join(row) + "\n" + "\t".join(["2", "2012-10-28T00:00:02Z", "x", "u", "d", "", "l", "z", "", "", ""]) + "\n")
    got = {r.tweet_id: r for r in files.tweets_tsv(spark, str(tmp_path)).collect()}
    r = got[262200000000000001]
    assert (r.text, r.user_description, r.lon, r.lat, r.geom_src) == ('a "quoted" text', None, 1.5, -2.5, "co") and got[2].lon is None and str(r.created_at) == "2012-10-28 00:00:01"


def test_sine_and_noise(spark):
    rows = files.sine(spark, "2020-01-01 00:00:00", "7 DAYS", 104, 52, 13).orderBy("period").collect()
    assert len(rows) == 104 and np.allclose([r.value for r in rows], np.sin((np.arange(104) + 13) * 2 * np.pi / 52)) and str(rows[1].period) == "2020-01-08 00:00:00"
    for kind, want in (("constant", [2.0] * 5), ("linear", [0, 0.5, 1, 1.5, 2]), ("pulse", [0, 2, 2, 0, 2])):
        assert [r.value for r in files.noise(spark, 5, kind, level=2.0, pulses=[(1, 2), (4, 1)]).orderBy("i").collect()] == want
    x = np.array([r.value for r in files.noise(spark, 4000, "normal", 3, 2.0).collect()])
    assert abs(x.mean()) < 0.2 and abs(x.std() - 2) < 0.2


def test_json_glue(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write('x\n{"a":\n1}\n{"b":2}\n\n2F\n{"c": [1,\n2,\n3]}\n')
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("\n".join(['{"broken": '] + ["y"] * 20) + '\n{"d":4}\n')
    assert sorted(r.json for r in files.json_glued(spark, str(tmp_path)).collect()) == ['{"a":1}', '{"b":2}', '{"c": [1,2,3]}', '{"d":4}']
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("\n".join((['{"broken": '] + ["y"] * 17) * 12))
    with pytest.raises(Exception, match="too many objects"):
        files.json_glued(spark, str(tmp_path)).count()


def test_write_tsv_and_fragments(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x y")], "day string, n int, s string")
    files.write_tsv(df, str(tmp_path / "t"), "day")
    assert (tmp_path / "t" / "day=a").exists() and [r.value for r in spark.read.text(str(tmp_path / "t" / "day=b")).collect()] == ["2\tx y"]
    s = spark.createDataFrame([("f", "1", "2015-01-01 00:00:00", 11.0), ("f", "1", "2015-02-01 02:00:00", 22.0)], "project string, article string, hour string, v double").withColumn("hour", F.to_timestamp("hour"))
    files.write_fragments(R.fragments(s, 4), str(tmp_path / "f"))
    files.write_fragments(R.fragments(s.where("v > 20"), 4), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 02:00:00"), ("w", "2024-01-01 05:00:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    said = []
    beat = live.heartbeat(said.append)
    spark.streams.addListener(beat)
    q = live.sessions(stream, "ts", "k").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.k, str(r.start), str(r.end), r.n) for r in spark.table("sessions").collect())
    assert got[:2] == [("u", "2024-01-01 00:00:00", "2024-01-01 00:50:00", 2), ("u", "2024-01-01 02:00:00", "2024-01-01 02:30:00", 1)]
    for _ in range(50):
        if said:
            break
        import time

        time.sleep(0.2)
    spark.streams.removeListener(beat)
    assert said and said[0] == 4


def test_month_store(spark, tmp_path):
    s = live.MonthStore(spark, str(tmp_path / "m"), ["k"], 10)

    def counts(*rows):
        return spark.createDataFrame(rows, "month string, k string, n long").withColumn("month", F.to_date("month"))

    assert s.update(counts(("2024-01-01", "a", 6), ("2024-01-01", "b", 3)), False) == {"2024-01-01": 1}
    assert s.update(counts(("2024-01-01", "a", 6), ("2024-01-01", "c", 1)), False) == {"2024-01-01": 0}
    assert sorted((r.k, r.n) for r in s.read().collect()) == [("a", 12), ("b", 3), ("c", 1)]
    assert s.update(counts(("2024-01-01", "b", 4), ("2024-02-01", "d", 2), ("2024-02-01", "e", 20)), True) == {"2024-01-01": 2, "2024-02-01": 3}
    assert sorted((r.k, r.n) for r in s.read().collect()) == [("a", 12), ("e", 20)]
    # another process finds what is there, and a numbered update counts once
    s = live.MonthStore(spark, str(tmp_path / "m"), ["k"], 10)
    assert s.strategy("2024-02-01", False) == 0 and s.strategy("2024-03-01", True) == 3
    for _ in range(2):
        s.update(counts(("2024-03-01", "f", 5)), False, 7)
    s.update(counts(("2024-03-01", "f", 6)), False, 8)
    assert sorted((r.k, r.n) for r in s.read().collect()) == [("a", 12), ("e", 20), ("f", 11)]
    hours = spark.createDataFrame([("2024-01-31 23:00:00",), ("2024-02-29 22:00:00",)], "hour string").select(F.to_timestamp("hour").alias("hour"))
    assert {str(r.month): r.closed for r in live.month_closed(hours, "hour").collect()} == {"2024-01-01": True, "2024-02-01": False}


def test_series_store(spark, tmp_path):
    """The worked example of two months with a threshold, and that a fetch reads the names' shards only."""
    rows = [("f", "1", "2015-01-01 00:00:00", 11.0), ("f", "1", "2015-01-01 02:00:00", 22.0), ("f", "1", "2015-02-28 23:00:00", 44.0), ("d", "0", "2015-01-01 00:00:00", 1.0), ("d", "0", "2015-02-01 00:00:00", 55.0)]
    s = spark.createDataFrame(rows, "project string, article string, hour string, v double").withColumn("hour", F.to_timestamp("hour"))
    store = SeriesStore(spark, str(tmp_path / "s"), 4)
    assert store.is_empty()
    store.save(R.fragments(s, 4), 20)
    assert {(r.name, str(r.fragment)) for r in store.fragments().collect()} == {("f+1", "2015-01-01"), ("f+1", "2015-02-01"), ("d+0", "2015-02-01")}
    got = {(r.name, str(r.fragment)): r for r in store.fetch(["f+1", "d+0", "none"]).collect()}
    assert len(got) == 4 and got["d+0", "2015-01-01"].total == 0 and len(got["d+0", "2015-01-01"].data) == 744 and got["f+1", "2015-02-01"].data[671] == 44
    assert {r.name for r in store.fetch(["f+1", "d+0"], latest_only=False).collect()} == {"f+1"}
    assert [r.name for r in store.missing(["f+1", "none"]).collect()] == ["none"]
    plan = store.named(["f+1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert shard_of("f+1", 4) == spark.range(1).select(N.shard(F.lit("f+1"), 4)).first()[0]
    # a month that comes again is replaced, the other stays
    store.save(R.fragments(s.where("v = 22"), 4))
    assert {(r.name, str(r.fragment), r.total) for r in store.fragments().collect()} == {("f+1", "2015-01-01", 22.0), ("f+1", "2015-02-01", 44.0), ("d+0", "2015-02-01", 55.0)}
    store.prune(40)
    assert {(r.name, r.total) for r in store.listing().collect()} == {("f+1", 44), ("d+0", 55)}
    store.save(R.fragments(s.where("v = 22"), 4))
    store.delete(["d+0"])
    assert {(r.fragment.month, r.hour, r.value) for r in store.dump().collect()} == {(1, 2, 22.0), (2, 671, 44.0)}


def test_jobs(spark):
    class Initials(mapreduce.Job):
        value, out = "string", "key string, words string"

        def map_init(self):
            self.low = self.params["low"]

        def map(self, item):
            for w in item["text"].split():
                yield w[0], w.lower() if self.low else w

        def reduce(self, key, values):
            yield key, "+".join(sorted(values))

    df = spark.createDataFrame([("Ant bee",), ("Bat ape",)], "text string")
    got = dict(map(tuple, mapreduce.run(df, Initials(**mapreduce.arguments("low=1"))).collect()))
    assert got == {"A": "ant", "a": "ape", "B": "bat", "b": "bee"} and mapreduce.by_name("Initials") is Initials
    assert mapreduce.arguments("a=1,b=2.5,c=x") == {"a": 1, "b": 2.5, "c": "x"}
    assert mapreduce.run(df.limit(0), mapreduce.WordCount()).count() == 0


def test_text_helpers(spark):
    assert S.without_common_prefix(["abc1", "abc22"]) == ["1", "22"] and S.partition_sentinel([1, 2, 3], 2) == ([1], [3]) and S.partition_sentinel([1], 9) == ([1], [])
    assert S.merge_dicts({"a": [1], "b": {"c": 2}}, {"a": [2], "b": {"c": 2, "d": 3}}) == {"a": [1, 2], "b": {"c": 2, "d": 3}}
    with pytest.raises(ValueError):
        S.merge_dicts({"a": 1}, {"a": 2})
    values = [0.0, 1.0, -2.5, 1234.56, 12346.0, 99999.0, 0.00012346, 0.000012346, 1e10, 3.14159, 100.0, 9.9996, 1e-300]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None), (98, float("nan"))], "k int, v double")
    got = {r.k: r.s for r in df.select("k", S.g4_text(F.col("v")).alias("s")).collect()}
    assert [got[k] for k in range(len(values))] == ["%.4g" % v for v in values] and got[99] == got[98] == ""
    r = spark.range(1).select(S.sparse_text(F.array(F.lit(0.0), F.lit(1.5), F.lit(0.0), F.lit(2.0))).alias("s"), S.bytes_text(F.lit(2048)).alias("b"), S.si_text(F.lit(1500)).alias("n"), S.keyword(F.lit(" Flu # x")).alias("k")).first()
    assert tuple(r) == ("1:1.5 3:2.0", "2.0 KiB", "1.5k", "flu")
    rows = spark.range(10).withColumn("g", F.lit(1))
    for text in ("0,2:4,-2:", ":3", "::4", "-1", "5:-2"):
        want = {i for part in text.split(",") for i in ([range(10)[int(part)]] if ":" not in part else range(10)[slice(*[int(x) if x else None for x in part.split(":")])])}
        assert {r.id for r in R.select_slices(rows, ["g"], [F.asc("id")], text).collect()} == want


def test_four_digits(spark):
    """Ties, and numbers just beside one, are rounded as in C."""
    values = [k / 16 for k in range(16000, 16100)] + [k * 1e-6 for k in range(123400, 123500)] + [k / 7 for k in range(7000, 7100)] + [0.5e-4, -1.0625, 9999.5, 99995.0, -0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = {r.k: r.s for r in df.select("k", S.g4_text(F.col("v")).alias("s")).collect()}
    assert [got[k] for k in range(len(values))] == ["%.4g" % v for v in values]


def test_numbers(spark):
    table = [("2012-01-01", 100.0), ("2012-01-11", 200.0)]
    df = spark.createDataFrame([("2012-01-01",), ("2012-01-06",), ("2012-01-11",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in df.select(N.expected_count(F.col("d"), table, 0.5)).collect()] == [5000.0, 7500.0, 10000.0]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(N.expected_count(F.lit("2013-01-01").cast("date"), table)).collect()
    with pytest.raises(Exception, match="whole days"):
        spark.range(1).select(N.days_diff(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-02 06:00:00").cast("timestamp"))).collect()
    # a square degree at the equator and one at 60 degrees north, by the sphere's own formula
    for lat in (0.0, 60.0):
        ring = np.array([[0, lat], [1, lat], [1, lat + 1], [0, lat + 1]])
        want = 6371.009**2 * np.radians(1) * (np.sin(np.radians(lat + 1)) - np.sin(np.radians(lat)))
        assert abs(N.ring_area(ring[:, 0], ring[:, 1]) / want - 1) < 1e-2
    # the ellipsoid: a degree of latitude at the equator and at the pole, of longitude at the equator
    d = N.vincenty(np.array([0.0, 0, 0]), np.array([0.0, 89, 0]), np.array([0.0, 0, 1]), np.array([1.0, 90, 0]))
    assert np.allclose(d, [110.574, 111.694, 111.320], atol=2e-3)


def test_ellipsoid_query(spark):
    """The registered distances against the sphere's, from which they differ by at most 0.6 %, and symmetric."""
    from wavelark.plans import catalog

    a = {(r.a, r.b): r.km for r in catalog.QUERIES["geodesic_ellipsoid"](spark, "/root/testdata/sf0.001").collect()}
    b = {(r.a, r.b): r.km for r in catalog.QUERIES["geodesic_sphere"](spark, "/root/testdata/sf0.001").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] / b[k] - 1) < 0.006 for k in a)


def test_blank_line_and_folder(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\n2\t\n\n3\ty\n")
    (tmp_path / "b.tsv").write_text("4\tz\n")
    assert sorted(map(tuple, files.tsv(spark, str(tmp_path), "n int, s string").collect())) == [(1, "x"), (2, None), (4, "z")]
    (tmp_path / "m").mkdir()
    for hour, line in (("010000", "en A%20b 2 1\nen A%20b 3 1\nde C 1 1\n"), ("020000", "en A%20b 4 1\n")):
        with gzip.open(tmp_path / "m" / f"pagecounts-20150102-{hour}.gz", "wt") as f:
            f.write(line)
    assert sorted((r.ngram, str(r.day), r.n) for r in files.month_folder(spark, str(tmp_path / "m")).collect()) == [("de C", "2015-01-02", 1), ("en A_b", "2015-01-02", 9)]


def test_ellipse_and_deceptiveness(spark):
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    ring = N.ellipse(np.array([1.0, -1.0]), cov, 0.9)
    d = ring - [1.0, -1.0]
    assert np.allclose(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), -2 * np.log(0.1)) and np.allclose(ring[0], ring[-1])
    assert N.ring_wkt(ring[:2]).startswith("POLYGON((") and N.ring_wkt(ring).count(",") == 63
    r = spark.range(1).select(*N.weight_deceptiveness(F.lit(2.0), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(r) == (0.5, 0.25, 0.25)


def test_resize_and_trim(spark):
    df = spark.createDataFrame([("2020-01-02", 1.0), ("2020-01-09", 2.0)], "day string, v double").withColumn("day", F.to_date("day"))
    assert [r.v for r in R.resize(df, "day", "v", "2020-01-01", "2020-01-03").orderBy("day").collect()] == [0.0, 1.0, 0.0]
    assert R.resize(df, "day", "v", "2020-01-03", "2020-01-01").count() == 0
    rows = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, None, 0.0), (None, 1.0, 1.0), (3.0, 1.0, 2.0)], "y double, a double, b double")
    assert sorted(r.y for r in R.trim_for_fit(rows, "y", ["a", "b"], 0.5, 2).collect()) == [1.0, 3.0]
    with pytest.raises(Exception, match="too few rows"):
        R.trim_for_fit(rows, "y", ["a", "b"], 1.0, 2).collect()


def test_sheets(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("t\tflu$norm\tcold\n2020-01-01\t\t1\n2020-01-02\t2\tNaN\n2020-01-03\t\t3\n2020-01-04\t6\t\n")
    got = {(r.name, r.period.day): r.v for r in files.vectors_tsv(spark, str(tmp_path / "v.tsv")).collect()}
    assert got == {("flu", 1): 0, ("flu", 2): 2, ("flu", 3): 4, ("flu", 4): 6, ("cold", 1): 1, ("cold", 2): 2, ("cold", 3): 3, ("cold", 4): 0}
    truth = spark.createDataFrame([("2020-01-03",)], "period string").withColumn("period", F.to_date("period"))
    assert {(r.name, r.v) for r in files.vectors_tsv(spark, str(tmp_path / "v.tsv"), truth).collect()} == {("flu", 4), ("cold", 3)}
    (tmp_path / "h.csv").write_text("date,flu,Influenza (Disease),rare\n2020-01-05,10000000,0,0\n2020-01-12,0,20000000,0\n2020-01-19,0,0,1\n2020-01-26,1,1,0\n")
    got = {(r.kind, r.name) for r in files.trends_csv(spark, str(tmp_path / "h.csv")).collect()}
    assert got == {("raw", "flu"), ("topic", "Influenza (Disease)")} and files.trends_csv(spark, str(tmp_path / "h.csv")).agg(F.max("v")).first()[0] == 2.0
    (tmp_path / "k.txt").write_text("# all\nFlu\ncold # x\n\nflu\n")
    words, digest = files.keywords(spark, str(tmp_path / "k.txt"))
    assert words == ["cold", "flu"] and len(digest) == 32
