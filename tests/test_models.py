"""Models, mixtures, locations and graphs against NumPy and plain Python."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelark.functions import numbers as N
from wavelark.operators import models as M
from wavelark.operators import series as R
from wavelark.plans import catalog, modelling
from wavelark.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key, slope in (("a", 2.0), ("b", -1.0)):
        x = rng.normal(size=(60, 2))
        for k in range(60):
            rows.append((key, k, float(x[k, 0]), float(x[k, 1]), float(3 + slope * x[k, 0] + 0.1 * rng.normal())))
    return spark.createDataFrame(rows, "key string, day int, x0 double, x1 double, y double")


def test_elastic_net_optimum():
    """No small step lowers the objective, with and without the sign constraint; a ridge without penalty is least squares."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(size=80) * 0.3
    for alpha, l1, positive in ((0.1, 0.9, False), (0.1, 0.9, True), (0.5, 1.0, False)):
        w = M.elastic_net(x, y, alpha, l1, positive)

        def cost(w):
            return ((y - w[0] - x @ w[1:]) ** 2).mean() / 2 + alpha * (l1 * np.abs(w[1:]).sum() + (1 - l1) / 2 * (w[1:] ** 2).sum())

        assert not positive or (w[1:] >= 0).all()
        for j in range(5):
            for d in (1e-3, -1e-3):
                v = w.copy()
                v[j] += d
                if not positive or v[1:].min() >= 0:
                    assert cost(v) >= cost(w) - 1e-9
    a = np.column_stack([np.ones(80), x])
    assert np.allclose(M.ridge(x, y, 0.0), np.linalg.lstsq(a, y, rcond=None)[0]) and np.allclose(M.ols(x, y)[0], M.ridge(x, y, 0.0))
    # a penalty of its own for each feature, the intercept free
    p = np.array([0, 5.0, 0.1, 1.0, 2.0])
    assert np.allclose(M.ridge(x, y, p[1:]), np.linalg.inv(a.T @ a + np.diag(p)) @ a.T @ y)


def test_forecast(spark, table):
    got = M.forecast(table, ["key"], ["x0", "x1"], "y", "day", 50, 40, alphas=np.logspace(-4, 1, 6), solver=M.ridge).toPandas()
    for key, df in table.toPandas().sort_values("day").groupby("key"):
        x, y = df[["x0", "x1"]].to_numpy(), df["y"].to_numpy()
        alpha = M.cross_validate(x[10:50], y[10:50], np.logspace(-4, 1, 6), solver=M.ridge)
        w = M.ridge(x[10:50], y[10:50], alpha)
        own = got[got.key == key].sort_values("day")
        assert np.allclose(own.prediction, w[0] + x[50:] @ w[1:]) and np.allclose(own.truth, y[50:])
        e = M.evaluate(spark.createDataFrame(own), ["key"]).first()
        assert np.isclose(e.rmse, np.sqrt(np.mean((own.truth - own.prediction) ** 2))) and np.isclose(e.r2, np.corrcoef(own.truth, own.prediction)[0, 1] ** 2)
    few = M.forecast(table.where("day < 5"), ["key"], ["x0", "x1"], "y", "day", 3).toPandas()
    assert few.prediction.isna().all() and len(few) == 4


def test_forecast_query(spark):
    """The registered forecasts, key by key."""
    t = Tables(spark, DATA)
    rows = modelling.lag_table(t).toPandas().sort_values(["project", "day"])
    for name, now, training, alphas, solver in (("forecast", 21, None, M.ALPHAS, M.elastic_net), ("forecast_ridge", 21, None, np.logspace(-4, 4, 20), M.ridge)):
        got = catalog.QUERIES[name](spark, DATA).toPandas()
        for key, df in rows.groupby("project"):
            x, y = df[modelling.LAGS].to_numpy(float), df["v"].to_numpy(float)
            ok = np.isfinite(x[:now]).all(1)
            w = solver(x[:now][ok], y[:now][ok], M.cross_validate(x[:now][ok], y[:now][ok], alphas, solver=solver))
            assert np.allclose(got[got.project == key].sort_values("day").prediction, w[0] + np.nan_to_num(x[now:]) @ w[1:])
    errors = catalog.QUERIES["forecast_errors"](spark, DATA).toPandas()
    assert len(errors) == 5 and (errors.n > 0).all() and (errors.rmse >= 0).all()


def test_sweep_and_penalties(spark, table):
    got = M.sweep(table, ["key"], ["x0", "x1"], "y", "day", 40, [0.1]).toPandas()
    pdf = table.toPandas().sort_values("day")
    for r in got.itertuples():
        df = pdf[pdf.key == r.key]
        x, y = df[["x0", "x1"]].to_numpy(), df["y"].to_numpy()
        w = M.SOLVERS[r.solver](x[:40], y[:40], 0.1)
        assert np.isclose(r.rmse, np.sqrt(np.mean((w[0] + x[40:] @ w[1:] - y[40:]) ** 2)))
    assert set(got.solver) == set(M.SOLVERS) and len(catalog.QUERIES["solver_sweep"](spark, DATA).toPandas()) == 60
    lambdas = np.logspace(-2, 2, 5)
    found = M.penalties(table, ["key"], ["x0", "x1"], "y", "day", {"x0": 0.1, "x1": 1.0}, lambdas, 4)
    best = {}
    for key, df in pdf.groupby("key"):
        x, y = df[["x0", "x1"]].to_numpy(), df["y"].to_numpy()
        cost = []
        for a in lambdas:
            e = []
            for f in np.array_split(np.arange(60), 4):
                keep = np.ones(60, bool)
                keep[f] = False
                design = np.column_stack([x[keep], np.ones(keep.sum())])
                w = np.linalg.inv(design.T @ design + a * np.diag([0.1, 1.0, 0])) @ design.T @ y[keep]
                e.append(np.sqrt(np.mean((np.column_stack([x[f], np.ones(len(f))]) @ w - y[f]) ** 2)))
            cost.append(np.mean(e))
        best[key] = lambdas[int(np.argmin(np.array(cost) + np.linspace(-1, 1, 5) ** 2 * 0.02))]
    assert {r.key: r["lambda"] for r in found.collect()} == best
    assert np.isclose(M.common_penalty(found).first()["lambda"], np.exp(np.mean(np.log(list(best.values())))))
    assert 1e-3 <= catalog.QUERIES["penalty_choice"](spark, DATA).first()["lambda"] <= 1e3


def test_lagged_ols(spark):
    rng = np.random.default_rng(4)
    days = [d.date() for d in pd.date_range("2024-01-01", periods=80)]
    x = rng.normal(size=(80, 3))
    y = np.roll(x @ [1.0, 2.0, -1.0], -5)  # the truth is five days ahead of the series
    wide = spark.createDataFrame([(d, *map(float, r)) for d, r in zip(days, x)], "day date, x0 double, x1 double, x2 double")
    truth = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y)], "day date, y double")
    got = {r.lag: r for r in M.lagged_ols(wide, "day", ["x0", "x1", "x2"], truth, "y", range(-7, 8)).collect()}
    assert max(got, key=lambda k: got[k].r2) == 5 and got[5].r2 > 0.999 and got[5].n == 75
    assert np.isclose(got[0].r2, 1 - ((y - np.column_stack([np.ones(80), x]) @ np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert catalog.QUERIES["lagged_ols"](spark, DATA).count() == 57


def test_synthetic_features():
    signal, bases = np.sin(np.arange(50) / 5) + 1, np.stack([np.ones(50), np.arange(50) / 50])
    x, decept, w = M.synthetic_features(signal, bases, 200, np.array([1.0, 1.0, 0.5, 0.5]), 3)
    assert x.shape == (200, 50) and (x >= 0).all() and np.allclose(w.sum(1), 1) and np.allclose(decept, w[:, 2:].sum(1))
    quiet = M.synthetic_features(signal, bases, 5, np.array([1e6, 1e-6, 1e-6, 1e-6]), 3)[0]
    assert np.allclose(quiet, signal / signal.max(), atol=1e-3)


def test_classifiers(spark):
    rows = [(k, ("good fine nice " if k % 2 else "bad poor awful ") * 5, k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    got = M.classifier_accuracy(df.where("id < 60"), df.where("id >= 60"), "text", "label", 256).collect()
    assert [(r.model, r.n, r.accuracy) for r in got] == [("logistic regression", 20, 1.0), ("naive Bayes", 20, 1.0)]


def test_training_mean_and_noise(spark, table):
    got = R.mix_noise(table.select("key", "day", "y"), ["key"], "day", "y", 0.25, 5).toPandas()
    base = table.toPandas()
    for key, df in got.groupby("key"):
        y = base[base.key == key].sort_values("day")["y"].to_numpy()
        other = (df.sort_values("day")["y"].to_numpy() - 0.75 * y) / 0.25
        assert np.allclose(np.sort(other), np.sort(y)) and not np.allclose(other, y)


def test_mixture_scores():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((0, 0), 0.5, (60, 2)), rng.normal((5, 5), 0.5, (60, 2))])
    found = M.gmm(x)
    s = M.mixture_scores(x, found)
    p = sum(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in found)
    assert np.isclose(s["log_likelihood"], np.log(p).sum()) and np.isclose(s["aic"], 2 * (6 * len(found) - 1) - 2 * np.log(p).sum())
    one = M.mixture_scores(x, [(1.0, x.mean(0), np.cov(x.T))])
    assert one["bic"] > s["bic"]


def test_mixture_queries(spark):
    """The registered mixtures are those of each token's points, and places are weighted means of their components."""
    t = Tables(spark, DATA)
    pts, got = modelling.points(t).toPandas(), catalog.QUERIES["token_mixtures"](spark, DATA).toPandas()
    for token, df in pts.groupby("token"):
        x = df.sort_values(["lon", "lat"])[["lon", "lat"]].to_numpy()
        own = got[got.token == token].sort_values("component")
        if len(x) < 3:
            assert own.empty
            continue
        found = M.gmm(x)
        assert np.allclose(own.weight, [w for w, _, _ in found]) and np.allclose(own[["lon", "lat"]], [m for _, m, _ in found])
        assert np.isclose(own.weight.sum(), 1)
    places = {r.id: (r.lon, r.lat) for r in catalog.QUERIES["locate_messages"](spark, DATA).collect()}
    for i, df in modelling.messages(t).toPandas().drop_duplicates().groupby("id"):
        c = got[got.token.isin(df.token)]
        c = c[c.weight > c.weight.max() * 1e-3]
        assert np.allclose(places[i], np.average(c[["lon", "lat"]], axis=0, weights=c.weight))
    scores = catalog.QUERIES["token_scores"](spark, DATA).toPandas()
    assert len(scores) == pts.token.nunique() and np.isfinite(scores[["aic", "bic"]]).all().all()


def test_estimate():
    e = M.Estimate([(0.7, np.array([0.0, 0.0]), np.eye(2)), (0.3, np.array([10.0, 10.0]), np.eye(2) * 0.25)], 0.9, 4000, 1)
    assert np.allclose(e.best_mean(), [3, 3]) and np.isclose(e.sae(3, 3), 0)
    # what is densest is the narrow component: .3 / (2 pi .25) > .7 / (2 pi)
    assert np.allclose(e.densest_mean(), [10, 10])
    assert abs(e.cae(0, 0) - np.mean(M._sphere(e.points[:, 0], e.points[:, 1], 0, 0))) < 1e-9
    assert e.covered(0, 0) and not e.covered(5, 5) and e.contour(5, 5) > 0.98 and e.contour(10, 10) < 0.05
    assert e.in_region(0, 0) and e.in_region(10, 10) and not e.in_region(5, 5)
    assert abs(np.mean([e.in_region(*p) for p in e.points]) - 0.9) < 0.03
    square = np.array([[-1.0, -1], [1, -1], [1, 1], [-1, 1]])
    assert abs(e.share_in(square) - 0.7 * 0.6827**2) < 0.03
    # areas: a square degree at the equator, twice over, and two that overlap by half
    one = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    assert abs(M.union_area([one, one]) / 12364 - 1) < 0.01 and abs(M.union_area([one, one + [0.5, 0]]) / M.union_area([one]) - 1.5) < 0.01
    assert len(M.hull(np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [1, 0]]))) == 4


def test_location_errors(spark):
    located = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.01, 0.0, 0.01), (2, 1.0, 20.0, 0.0, 0.01, 0.0, 0.01)], "id long, weight double, lon double, lat double, cxx double, cxy double, cyy double")
    truth = spark.createDataFrame([(1, 0.0, 0.0), (2, 21.0, 0.0)], "id long, true_lon double, true_lat double")
    got = {r.id: r for r in M.location_errors(located, truth).collect()}
    assert got[1].sae < 1e-6 and got[1].covered and abs(got[2].sae - 111.195) < 0.01 and not got[2].covered
    # a normal in two dimensions of 0.1 degrees: mean distance sd * sqrt(pi / 2), region about 6 pi sd^2
    assert abs(got[1].cae / (11.1195 * np.sqrt(np.pi / 2)) - 1) < 0.1 and abs(got[1].area_km2 / (5.99 * np.pi * 11.1195**2) - 1) < 0.25


def plain_area(polygons, steps):
    """Spans of every polygon along every line, one by one."""
    flat = [np.column_stack(N.mollweide(p[:, 0], p[:, 1])) for p in polygons]
    lo, hi = min(p[:, 0].min() for p in flat), max(p[:, 0].max() for p in flat)
    total = 0.0
    for x in lo + (np.arange(steps) + 0.5) * (hi - lo) / steps:
        spans, end = [], -np.inf
        for p in flat:
            y = [a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) for a, b in zip(p, np.roll(p, -1, axis=0)) if min(a[0], b[0]) <= x < max(a[0], b[0])]
            if len(y) >= 2:
                spans.append((min(y), max(y)))
        for y0, y1 in sorted(spans):
            total += max(0.0, y1 - max(y0, end))
            end = max(end, y1)
    return total * (hi - lo) / steps


def test_location_errors_of_many(spark):
    """Two thousand messages of the same thirty components, beside some of their own, take no estimate each; samples and areas are those of one at a time."""
    rng = np.random.default_rng(5)
    found = sorted((float(rng.normal() * 5), float(rng.normal() * 5), float(rng.random() + 0.1)) for _ in range(30))
    cov = np.array([[0.5, 0.2], [0.2, 0.4]])
    e = M.Estimate([(w, np.array([x, y]), cov) for x, y, w in found], samples=200)
    again = np.random.default_rng(0)
    pick = again.choice(30, 200, p=e.w)
    one_by_one = np.stack([again.multivariate_normal(found[k][:2], cov) for k in pick])
    assert np.allclose(np.sort(e.points, axis=0), np.sort(one_by_one, axis=0))
    density = np.log(sum(w * np.exp(M.density(e.points, np.array(m), cov)) for w, m in zip(e.w, [f[:2] for f in found])))
    assert np.allclose(e.score, density) and np.isclose(M.union_area(e.region, 200), plain_area(e.region, 200))
    far = [np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]]) + [k % 3 * 0.4, k // 3 * 3.0] for k in range(9)]
    assert np.isclose(M.union_area(far, 300), plain_area(far, 300))
    parts = spark.createDataFrame([(x, y, w, 0.5, 0.2, 0.4) for x, y, w in found], "lon double, lat double, weight double, cxx double, cxy double, cyy double")
    own = spark.range(2000, 2010).select("id", (F.col("id") * 1.0).alias("weight"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), (F.col("id") - 1999.0).alias("cxx"), F.lit(0.0).alias("cxy"), F.lit(1.0).alias("cyy"))
    located = spark.range(2000).crossJoin(parts).unionByName(own)
    truth = spark.range(2010).select("id", (F.col("id") % 7 - 3.0).alias("true_lon"), (F.col("id") % 5 - 2.0).alias("true_lat"))
    began = time.time()
    got = {r.id: r for r in M.location_errors(located, truth, samples=200).collect()}
    assert time.time() - began < 60 and len(got) == 2010
    for k in (0, 3, 1999):
        x, y = k % 7 - 3.0, k % 5 - 2.0
        assert np.allclose(got[k][1:], [e.sae(x, y), e.cae(x, y), e.contour(x, y), e.covered(x, y), M.union_area(e.region, 200)])
    alone = M.Estimate([(1.0, np.array([1.0, 2.0]), np.diag([10.0, 1.0]))], samples=200)
    assert np.allclose(got[2009][1:4], [alone.sae(2009 % 7 - 3.0, 2.0), alone.cae(2009 % 7 - 3.0, 2.0), alone.contour(2009 % 7 - 3.0, 2.0)])


def test_weights(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.001), ("a", 0.0, -0.001), ("b", 0.0, 5.0), ("b", 0.0, -5.0), ("b", 0.0, 0.0), ("c", 1.0, 1.0)], "token string, lon double, lat double")
    models = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("c", 1.0, 1.0, 1.0)], "token string, weight double, lon double, lat double")
    got = {r.token: r for r in M.token_weights(points, models).collect()}
    e = 2 * 6371.009 * np.arcsin(np.sin(np.radians(0.001) / 2)) * 2 / 3
    assert np.isclose(got["a"].error, e) and np.isclose(got["a"].weight, 1 / (1 + e**4)) and got["b"].weight < 1e-8 and got["c"].weight == 0
    scores = spark.createDataFrame([("a", 100.0), ("b", -100.0), ("c", 1.0)], "token string, aic double")
    turned = {r.token: r.weight for r in M.feature_weights(scores, "aic", True).collect()}
    assert turned == {"a": 1.0, "b": 201.0, "c": 100.0}
    plain = {r.token: r.weight for r in M.feature_weights(scores.where("aic > 0"), "aic").collect()}
    assert np.isclose(plain["a"], 1 / 101) and plain["c"] == 0.5
    mixed = {r.token: r.weight for r in M.feature_weights(scores, "aic").collect()}
    assert mixed["c"] == 1.0 and np.isclose(mixed["b"], np.exp(-1 / 99 - 0.5))


def test_weight_optimiser(spark):
    rng = np.random.default_rng(6)
    rows = [(i, t, float(abs(rng.normal()) * (1 if t == "good" else 20))) for i in range(40) for t in ("good", "bad")]
    costs = spark.createDataFrame(rows, "id long, token string, cost double")
    w = M.optimise_weights(costs, steps=12, ridge_=0.01)
    got = {r.token: r.w for r in w.collect()}
    c = np.array([[r[2] for r in rows if r[0] == i] for i in range(40)])

    def f(a, b):
        s = 1 / (1 + np.exp(-np.array([a, b])))
        return (c @ s / s.sum()).sum() + 0.01 * (a * a + b * b) / 2

    assert f(got["good"], got["bad"]) < 0.5 * f(0, 0) and got["good"] > 0 > got["bad"]
    assert np.isclose(M.weighted_cost(costs, w).first().total, f(got["good"], got["bad"]) - 0.01 * (got["good"] ** 2 + got["bad"] ** 2) / 2)
    # the first step is down the gradient of the objective
    one = {r.token: r.w for r in M.optimise_weights(costs, steps=1, ridge_=0.01, rate=1e-3).collect()}
    slope = [(f(1e-5, 0) - f(-1e-5, 0)) / 2e-5, (f(0, 1e-5) - f(0, -1e-5)) / 2e-5]
    assert np.allclose([one["good"], one["bad"]], -1e-3 * np.sign(slope))


def test_locators(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.1, 0.0), ("a", 0.0, 0.1), ("a", 9.0, 9.0), ("b", 0.05, 0.05), ("z", 50.0, 50.0)], "token string, lon double, lat double")
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "z"), (3, "none")], "id long, token string")
    got = {r.id: r for r in M.locate_kde(m, points).collect()}
    assert set(got) == {1, 2} and (got[1].lon, got[1].lat, got[1].n) == (0.05, 0.05, 5) and got[2].lon == 50
    fixed = M.locate_fixed(m, 1.0, 2.0, 0)
    assert fixed.count() == 3 and M.locate_fixed(spark.range(7000).select("id"), 1.0, 2.0).count() in range(5800, 6200)
    both = {r.id: r.lon for r in M.first_of(M.locate_kde(m, points), M.locate_everywhere(m, points)).collect()}
    assert both[2] == 50 and np.isclose(both[3], np.mean([0, 0.1, 0, 9, 0.05, 50]))


def test_pooled_means(spark):
    """As of the pooled points themselves, with repeated tokens, tokens without points and unknown coordinates; and 20,000 messages of a token with 40,000 points."""
    points = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None), ("b", 5.0, 7.0), ("b", 6.0, 7.5), ("c", None, 1.0), (None, 1.0, 1.0)], "token string, lon double, lat double")
    m = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "none"), (4, "c"), (5, None)], "id long, token string")
    rows = M.pooled_points(m, points).groupBy("id").agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    assert sorted(map(tuple, M.pooled_means(m, points).collect())) == sorted(map(tuple, rows.collect()))

    class Many:
        conversations = spark.range(20000).select(F.col("id").alias("conv_id"), F.lit(3).alias("turn"))
        embeddings = spark.range(40000).select(F.lit(3).alias("label"), F.array(*[(F.col("id") / 40000).cast("float")] * 2).alias("embedding"))

    began = time.time()
    got = modelling.pooled_points(Many).agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("lon").alias("lon")).first()
    assert (got.k, got.lo, got.hi) == (20000, 40000, 40000) and abs(got.lon - 5) < 1e-3 and time.time() - began < 60


def brute_distance(parents, a, b, most=8):
    if not parents.get(a) or not parents.get(b):
        return most
    x, y, fx, fy = set(), set(), {a}, {b}
    for d in range(1, most + 1):
        x, y = x | {p for n in fx for p in parents.get(n, ())}, y | {p for n in fy for p in parents.get(n, ())}
        if x & y:
            return d
        fx, fy = set(x), set(y)
    return most


def test_category_distance(spark):
    rng = np.random.default_rng(8)
    edges = {(f"k{rng.integers(40)}", f"k{rng.integers(40)}") for _ in range(50)} | {(f"c{i}", f"c{i + 1}") for i in range(12)} | {("x", "c0"), ("y", "c7"), ("y", "d"), ("z", "c9")}
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    names = [f"k{i}" for i in range(12)] + ["x", "y", "z", "alone"]
    pairs = list(itertools.product(names, names))
    got = M.category_distance(spark.createDataFrame(sorted(edges), "child string, parent string"), spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {(r.a, r.b): r.distance for r in got} == {(a, b): brute_distance(parents, a, b) for a, b in pairs}
    assert len({r.distance for r in got}) >= 4
    # the example of the article tree: shared categories after one, after two, and none
    tree = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "D"), ("C", "E"), ("F", "B"), ("F", "D"), ("G", "E")], "child string, parent string")
    few = spark.createDataFrame([("A", "F"), ("A", "G"), ("A", "H"), ("F", "G"), ("H", "H")], "a string, b string")
    assert {(r.a, r.b): r.distance for r in M.category_distance(tree, few).collect()} == {("A", "F"): 1, ("A", "G"): 2, ("A", "H"): 8, ("F", "G"): 8, ("H", "H"): 8}
