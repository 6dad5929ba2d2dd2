"""Regression, mixtures and graphs: NumPy inside grouped maps where Spark has no equivalent."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray | float) -> np.ndarray:
    """Coefficients with a free intercept first; the penalty may differ by feature."""
    a = np.column_stack([np.ones(len(x)), x])
    p = np.concatenate([[0], np.broadcast_to(penalty, x.shape[1])])
    return np.linalg.lstsq(a.T @ a + np.diag(p), a.T @ y, rcond=None)[0]


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float = 0.9, positive: bool = True, steps: int = 500) -> np.ndarray:
    """Coordinate descent on centred data; returns intercept and coefficients."""
    mx, my = x.mean(0), y.mean()
    a, r = x - mx, y - my
    n, w = len(x), np.zeros(x.shape[1])
    sq = (a * a).sum(0) / n
    r = r.copy()
    for _ in range(steps):
        most = 0.0
        for j in range(len(w)):
            if sq[j] == 0:
                continue
            rho = a[:, j] @ r / n + sq[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (sq[j] + alpha * (1 - l1))
            if positive:
                new = max(new, 0.0)
            if new != w[j]:
                r -= a[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < 1e-9:
            break
    return np.concatenate([[my - mx @ w], w])


def cross_validate(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, k: int = 3, solver=elastic_net) -> float:
    """The alpha of least squared error over k contiguous folds; the smaller on ties."""
    cuts = np.array_split(np.arange(len(y)), k)
    cost = []
    for a in sorted(alphas):
        e = 0.0
        for f in cuts:
            rest = np.setdiff1d(np.arange(len(y)), f)
            w = solver(x[rest], y[rest], a)
            e += float(((w[0] + x[f] @ w[1:] - y[f]) ** 2).sum())
        cost.append(e)
    return float(np.sort(alphas)[int(np.argmin(cost))])


ALPHAS = np.logspace(-15, 2, 25)


def forecast(table: DataFrame, keys: list[str], features: list[str], target: str, time: str, now: int, training: int | None = None, alphas: np.ndarray = ALPHAS, solver=elastic_net) -> DataFrame:
    """Fits each key's rows at positions [now - training, now) (from the first one without ``training``) and predicts the later ones, the penalty cross-validated.

    Features and targets that aren't numbers leave a row out of the fit, and count as 0 in a prediction; with fewer than 4 rows predictions are null.
    """
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in [*keys, time])

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(time)
        x, y = df[features].to_numpy(float), df[target].to_numpy(float)
        past = slice(max(0, now - training) if training else 0, now)
        ok = np.isfinite(x[past]).all(1) & np.isfinite(y[past])
        out = df[[*keys, time]].iloc[now:].copy()
        out["truth"] = y[now:]
        if ok.sum() < 4:
            out["prediction"] = np.nan
            return out
        w = solver(x[past][ok], y[past][ok], cross_validate(x[past][ok], y[past][ok], alphas, solver=solver))
        out["prediction"] = w[0] + np.nan_to_num(x[now:]) @ w[1:]
        return out

    return table.groupBy(*keys).applyInPandas(one, f"{kinds}, truth double, prediction double")


def evaluate(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Error and r squared of predictions against the truth where both are known."""
    from .series import pearson

    both = predictions.where("truth IS NOT NULL AND prediction IS NOT NULL AND NOT isnan(truth) AND NOT isnan(prediction)")
    r = pearson(F.col("truth"), F.col("prediction"))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("truth") - F.col("prediction"), 2))).alias("rmse"), F.pow(r, 2).alias("r2"))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients with the intercept first, and r squared."""
    w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    rest, all_ = ((y - w[0] - x @ w[1:]) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return w, float(1 - rest / all_) if all_ > 0 else 0.0


def lagged_ols(wide: DataFrame, day: str, features: list[str], truth: DataFrame, target: str, lags: range) -> DataFrame:
    """Rows (lag, n, r2): regressions of the truth on several series at every lag in days, the truth moved later by the lag. There is one row a day, so a lag is a small group."""
    moved = truth.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), day, target).withColumn(day, F.date_add(day, F.col("lag")))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(day)
        x, y = df[features].to_numpy(float), df[target].to_numpy(float)
        return pd.DataFrame([(int(df["lag"].iloc[0]), len(df), ols(x, y)[1] if len(df) > len(features) + 1 else np.nan)], columns=["lag", "n", "r2"])

    return wide.join(moved, day).groupBy("lag").applyInPandas(one, "lag int, n long, r2 double")


SOLVERS = {
    "ols": lambda x, y, a: ols(x, y)[0],
    "ridge": lambda x, y, a: ridge(x, y, a),
    "lasso": lambda x, y, a: elastic_net(x, y, a, 1.0, False),
    "lasso positive": lambda x, y, a: elastic_net(x, y, a, 1.0, True),
    "elastic net": lambda x, y, a: elastic_net(x, y, a, 0.9, False),
    "elastic net positive": lambda x, y, a: elastic_net(x, y, a, 0.9, True),
}


def sweep(table: DataFrame, keys: list[str], features: list[str], target: str, time: str, now: int, alphas: list[float], solvers: list[str] | None = None) -> DataFrame:
    """Rows (keys, solver, alpha, rmse): every solver and penalty fitted before ``now`` and tested after it."""
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    options = F.explode(F.array(*[F.lit(s) for s in solvers or SOLVERS])).alias("solver")

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(time)
        x, y = np.nan_to_num(df[features].to_numpy(float)), df[target].to_numpy(float)
        rows = []
        for a in alphas:
            w = SOLVERS[df["solver"].iloc[0]](x[:now], y[:now], a)
            rows.append((*df[keys].iloc[0], df["solver"].iloc[0], float(a), float(np.sqrt(np.mean((w[0] + x[now:] @ w[1:] - y[now:]) ** 2)))))
        return pd.DataFrame(rows, columns=[*keys, "solver", "alpha", "rmse"])

    return table.select("*", options).groupBy(*keys, "solver").applyInPandas(one, f"{kinds}, solver string, alpha double, rmse double")


def penalties(table: DataFrame, keys: list[str], features: list[str], target: str, time: str, penalty: dict[str, float], lambdas: np.ndarray, folds: int = 5) -> DataFrame:
    """Rows (keys, lambda, rmse): each key's best strength of a ridge with a penalty for each feature, by contiguous folds, biased toward the middle of ``lambdas``."""
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    bias = np.linspace(-1, 1, len(lambdas)) ** 2 * 0.02
    own = np.array([penalty[f] for f in features])

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(time)
        x, y = df[features].to_numpy(float), df[target].to_numpy(float)
        cost = []
        for a in lambdas:
            errors = []
            for f in np.array_split(np.arange(len(y)), folds):
                rest = np.setdiff1d(np.arange(len(y)), f)
                w = ridge(x[rest], y[rest], a * own)
                errors.append(np.sqrt(np.mean((w[0] + x[f] @ w[1:] - y[f]) ** 2)))
            cost.append(np.mean(errors))
        best = int(np.argmin(cost + bias))
        return pd.DataFrame([(*df[keys].iloc[0], float(lambdas[best]), float(cost[best]))], columns=[*keys, "lambda", "rmse"])

    return table.groupBy(*keys).applyInPandas(one, f"{kinds}, lambda double, rmse double")


def common_penalty(found: DataFrame) -> DataFrame:
    """The geometric mean of the keys' strengths."""
    return found.agg(F.exp(F.avg(F.log("lambda"))).alias("lambda"))


def synthetic_features(signal: np.ndarray, bases: np.ndarray, count: int, alpha: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count`` features, their systematic deceptiveness and weights: Dirichlet weights of the signal, of normal noise and of each base; sums below 0 are 0."""
    rng = np.random.default_rng(seed)
    signal = signal / signal.max()
    w = rng.dirichlet(alpha, count)
    x = np.maximum(w[:, :1] * signal + w[:, 1:2] * rng.normal(size=(count, len(signal))) + w[:, 2:] @ bases, 0)
    return x, w[:, 2:].sum(1) / w.sum(1), w


def training_mean(df: DataFrame, keys: list[str], time: str, value: str, now: int) -> DataFrame:
    """The mean of the rows before position ``now`` as the prediction of the later ones."""
    from pyspark.sql.window import Window

    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    mean = rows.where(F.col("_i") < now).groupBy(*keys).agg(F.avg(value).alias("prediction"))
    return rows.where(F.col("_i") >= now).join(mean, keys, "left").select(*keys, time, F.col(value).alias("truth"), "prediction")


def classifier_accuracy(train: DataFrame, test: DataFrame, text: str, label: str, features: int = 4096) -> DataFrame:
    """Rows (model, n, accuracy) of logistic regression and naive Bayes on hashed word counts."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import HashingTF

    from ..functions import strings as S

    tf = HashingTF(numFeatures=features, inputCol="_words", outputCol="_counts")
    a, b = (tf.transform(d.where(F.col(label).isNotNull()).select(S.tokens_space(F.col(text)).alias("_words"), F.col(label).cast("double").alias("_label"))) for d in (train, test))
    out = None
    for name, kind in (("logistic regression", LogisticRegression(featuresCol="_counts", labelCol="_label", regParam=0.01)), ("naive Bayes", NaiveBayes(featuresCol="_counts", labelCol="_label"))):
        made = kind.fit(a).transform(b)
        row = made.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("_label")).cast("int")).alias("accuracy"))
        out = row if out is None else out.union(row)
    return out


def gmm(points: np.ndarray, seed: int = 0, floor: float = 1e-3, steps: int = 100) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Full-covariance mixture by EM; components of fewer than 3 points are dropped (one is refitted if none stay)."""
    n = len(points)
    k = int(min(max(round(np.log2(max(n, 2)) / 2), 1), 20))
    rng = np.random.default_rng(seed)

    def em(k: int):
        mean = points[rng.choice(n, k, replace=False)].astype(float)
        cov = np.array([np.cov(points.T) if n > 1 else np.zeros((2, 2))] * k) + np.eye(2) * floor
        w = np.full(k, 1 / k)
        last = -np.inf
        for _ in range(steps):
            lp = np.stack([np.log(w[j] + 1e-300) + density(points, mean[j], cov[j]) for j in range(k)], 1)
            top = lp.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(lp - top).sum(1))
            r = np.exp(lp - total[:, None])
            m = r.sum(0) + 1e-12
            w, mean = m / n, (r.T @ points) / m[:, None]
            cov = np.stack([(r[:, j, None] * (points - mean[j])).T @ (points - mean[j]) / m[j] + np.eye(2) * floor for j in range(k)])
            if abs(total.sum() - last) < 1e-6 * n:
                break
            last = total.sum()
        size = np.bincount(r.argmax(1), minlength=k)
        return [(w[j], mean[j], cov[j]) for j in range(k) if size[j] >= 3]

    found = em(k) or em(1) or [(1.0, points.mean(0), np.cov(points.T) + np.eye(2) * floor if n > 1 else np.eye(2) * floor)]
    total = sum(w for w, _, _ in found)
    return [(w / total, m, c) for w, m, c in found]


def density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of a 2-d normal."""
    d = x - mean
    inv, det = np.linalg.inv(cov), np.linalg.det(cov)
    return -0.5 * np.einsum("ij,jk,ik->i", d, inv, d) - np.log(2 * np.pi) - 0.5 * np.log(det)


GMM = "weight double, lon double, lat double, cxx double, cxy double, cyy double, component int, n long"


def token_models(points: DataFrame, least: int = 3) -> DataFrame:
    """Mixture components (token, weight, lon, lat, cxx, cxy, cyy, component, n) for each token of at least ``least`` points."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(["lon", "lat"])[["lon", "lat"]].to_numpy(float)
        rows = [(df.token.iloc[0], w, *m, c[0, 0], c[0, 1], c[1, 1], j, len(x)) for j, (w, m, c) in enumerate(gmm(x))] if len(x) >= least else []
        return pd.DataFrame(rows, columns=["token", "weight", "lon", "lat", "cxx", "cxy", "cyy", "component", "n"])

    return points.where("lon is not null and lat is not null and token is not null").groupBy("token").applyInPandas(one, "token string, " + GMM)


def mixture_scores(points: np.ndarray, found: list) -> dict[str, float]:
    """Log-likelihood, AIC, BIC and sizes of a mixture on its points."""
    lp = np.stack([np.log(w) + density(points, m, c) for w, m, c in found], 1)
    top = lp.max(1, keepdims=True)
    total = float((top[:, 0] + np.log(np.exp(lp - top).sum(1))).sum())
    k, covs = 6 * len(found) - 1, np.array([c for _, _, c in found])
    variance = float(sum(np.trace(c) for c in covs))
    return {"log_likelihood": total, "aic": 2 * k - 2 * total, "bic": k * np.log(len(points)) - 2 * total, "n_components": len(found), "variance": variance, "variance_comp": variance / len(found), "covar_sumsum": float(covs.sum()), "covar_sumprod": float(sum(c.prod() for c in covs))}


def token_scores(points: DataFrame, least: int = 3) -> DataFrame:
    """Rows (token, n, log_likelihood, aic, bic, variance, covar_sumsum, covar_sumprod) of each token's mixture."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(["lon", "lat"])[["lon", "lat"]].to_numpy(float)
        names = ["log_likelihood", "aic", "bic", "variance", "covar_sumsum", "covar_sumprod"]
        rows = []
        if len(x) >= least:
            s = mixture_scores(x, gmm(x))
            rows = [(df.token.iloc[0], len(x), *(s[n] for n in names))]
        return pd.DataFrame(rows, columns=["token", "n", *names])

    kinds = "token string, n long, log_likelihood double, aic double, bic double, variance double, covar_sumsum double, covar_sumprod double"
    return points.where("lon is not null and lat is not null and token is not null").groupBy("token").applyInPandas(one, kinds)


def _sphere(lon1, lat1, lon2, lat2) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.009 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def hull(p: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def turn(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def inside(polygon: np.ndarray, x: float, y: float) -> bool:
    """Whether a convex counter-clockwise polygon covers a point."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    return bool(((b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0]) >= -1e-12).all())


def union_area(polygons: list[np.ndarray], steps: int = 2000) -> float:
    """Square km that convex polygons cover together: spans of each, merged along ``steps`` lines in an equal-area projection."""
    from ..functions.numbers import mollweide

    flat = [np.column_stack(mollweide(p[:, 0], np.clip(p[:, 1], -89.99, 89.99))) for p in polygons]
    if not flat:
        return 0.0
    lo, hi = min(p[:, 0].min() for p in flat), max(p[:, 0].max() for p in flat)
    at = lo + (np.arange(steps) + 0.5) * (hi - lo) / steps
    low, high = np.full((len(flat), steps), np.inf), np.full((len(flat), steps), -np.inf)
    for k, p in enumerate(flat):
        a, b = p[:, None], np.roll(p, -1, axis=0)[:, None]
        cross = (np.minimum(a[..., 0], b[..., 0]) <= at) & (np.maximum(a[..., 0], b[..., 0]) > at)
        width = np.where(cross, b[..., 0] - a[..., 0], 1.0)
        y = a[..., 1] + (at - a[..., 0]) / width * (b[..., 1] - a[..., 1])
        two = cross.sum(0) >= 2
        low[k, two] = np.where(cross, y, np.inf).min(0)[two]
        high[k, two] = np.where(cross, y, -np.inf).max(0)[two]
    order = np.argsort(low, axis=0, kind="stable")
    low, high = np.take_along_axis(low, order, 0), np.take_along_axis(high, order, 0)
    # a span adds what is above all that begin below it
    end = np.vstack([np.full((1, steps), -np.inf), np.maximum.accumulate(high, axis=0)[:-1]])
    some = high > -np.inf
    return float(np.maximum(0.0, high[some] - np.maximum(low, end)[some]).sum()) * (hi - lo) / steps


class Estimate:
    """Where a message may be: samples of its mixture, best first, and the region that holds ``coverage`` of them."""

    def __init__(self, found: list, coverage: float = 0.95, samples: int = 1000, seed: int = 0):
        rng = np.random.default_rng(seed)
        w = np.array([x for x, _, _ in found])
        self.found, self.coverage, w = found, coverage, w / w.sum()
        self.w = w
        self.means, cov = np.array([m for _, m, _ in found], float), np.array([c for _, _, c in found], float)
        self.inv, self.base = np.linalg.inv(cov), np.log(w) - np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(cov))
        pick = rng.choice(len(found), samples, p=w)
        # each sample as multivariate_normal has it, from the same random numbers
        _, s, v = np.linalg.svd(cov)
        p = self.means[pick] + np.einsum("ni,nij->nj", rng.standard_normal((samples, 2)), (np.sqrt(s)[:, :, None] * v)[pick])
        lp = self._scores(p)
        best = np.argsort(-self.total(lp), kind="stable")
        self.points, self.score, self.of = p[best], self.total(lp)[best], lp.argmax(1)[best]
        cut = int(round(coverage * samples))
        self.threshold = float(self.score[min(cut, samples - 1)])
        top = self.of[:cut]
        self.region = [hull(self.points[:cut][top == k]) for k in range(len(found)) if (top == k).sum() >= 3]

    def _scores(self, p: np.ndarray) -> np.ndarray:
        d = p[:, None] - self.means
        return self.base - 0.5 * (d[..., 0] ** 2 * self.inv[:, 0, 0] + d[..., 0] * d[..., 1] * (self.inv[:, 0, 1] + self.inv[:, 1, 0]) + d[..., 1] ** 2 * self.inv[:, 1, 1])

    @staticmethod
    def total(lp: np.ndarray) -> np.ndarray:
        top = lp.max(1, keepdims=True)
        return top[:, 0] + np.log(np.exp(lp - top).sum(1))

    def at(self, lon: float, lat: float) -> float:
        return float(self.total(self._scores(np.array([[lon, lat]])))[0])

    def best_mean(self) -> np.ndarray:
        """The weighted mean of the means."""
        return np.average([m for _, m, _ in self.found], axis=0, weights=self.w)

    def densest_mean(self) -> np.ndarray:
        """The mean of highest density."""
        return max((m for _, m, _ in self.found), key=lambda m: self.at(*m))

    def sae(self, lon: float, lat: float) -> float:
        return float(_sphere(*self.best_mean(), lon, lat))

    def cae(self, lon: float, lat: float) -> float:
        ok = np.abs(self.points[:, 1]) < 89.99
        return float(_sphere(self.points[ok, 0], self.points[ok, 1], lon, lat).mean())

    def contour(self, lon: float, lat: float) -> float:
        return float((self.score > self.at(lon, lat)).mean())

    def covered(self, lon: float, lat: float) -> bool:
        return self.at(lon, lat) > self.threshold

    def in_region(self, lon: float, lat: float) -> bool:
        return any(inside(p, lon, lat) for p in self.region)

    def share_in(self, polygon: np.ndarray) -> float:
        """Likelihood of a convex polygon: the share of samples in it."""
        return float(np.mean([inside(polygon, *p) for p in self.points]))


#: Mixtures whose estimates a task keeps.
KEPT = 256


def location_errors(located: DataFrame, truth: DataFrame, coverage: float = 0.95, samples: int = 1000) -> DataFrame:
    """Rows (id, sae, cae, contour, covered, area_km2) for messages' components (id, weight, lon, lat, cxx, cxy, cyy) and true points (id, true_lon, true_lat).

    Messages of the same components (those of the same tokens) share an estimate; only their true points differ.
    """

    def errors(batches):
        known: OrderedDict = OrderedDict()
        for df in batches:
            rows = []
            for r in df.itertuples():
                key = r.found.tobytes()
                if key not in known:
                    e = Estimate([(c[2], c[:2], c[[3, 4, 4, 5]].reshape(2, 2)) for c in r.found.reshape(-1, 6)], coverage, samples)
                    known[key] = e, union_area(e.region, 200)
                    if len(known) > KEPT:
                        known.popitem(last=False)
                known.move_to_end(key)
                (e, area), x, y = known[key], r.true_lon, r.true_lat
                rows.append((r.id, e.sae(x, y), e.cae(x, y), e.contour(x, y), e.covered(x, y), area))
            yield pd.DataFrame(rows, columns=["id", "sae", "cae", "contour", "covered", "area_km2"])

    kind = located.schema["id"].dataType.simpleString()
    parts = ["lon", "lat", "weight", "cxx", "cxy", "cyy"]
    found = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in parts])))
    rows = located.join(truth, "id").groupBy("id").agg(F.flatten(F.transform(found, lambda c: F.array(*[c[k] for k in parts]))).alias("found"), F.first("true_lon").alias("true_lon"), F.first("true_lat").alias("true_lat"))
    return rows.mapInPandas(errors, f"id {kind}, sae double, cae double, contour double, covered boolean, area_km2 double")


def token_weights(points: DataFrame, models: DataFrame, exponent: float = 4.0, least: int = 3) -> DataFrame:
    """Rows (token, error, weight): min(1, 1 / (1 + e^x)) of the mean distance of a token's points from its model's best point; 0 with fewer than ``least`` points."""
    from ..functions.numbers import sphere_km

    best = models.groupBy("token").agg((F.sum(F.col("weight") * F.col("lon")) / F.sum("weight")).alias("best_lon"), (F.sum(F.col("weight") * F.col("lat")) / F.sum("weight")).alias("best_lat"))
    km = sphere_km(F.col("best_lon"), F.col("best_lat"), F.col("lon"), F.col("lat"))
    e = points.join(best, "token").groupBy("token").agg(F.avg(km).alias("error"), F.count("*").alias("n"))
    return e.select("token", "error", F.when(F.col("n") >= least, F.least(F.lit(1.0), 1 / (1 + F.pow("error", exponent)))).otherwise(F.lit(0.0)).alias("weight"))


def feature_weights(scores: DataFrame, feature: str, turned: bool = False) -> DataFrame:
    """Rows (token, weight) by a feature: its inverse, brought below 1 if some are negative; or ``turned``, so that small values weigh most (only if some are negative)."""
    from pyspark.sql.window import Window

    x = F.col(feature)
    whole = Window.partitionBy()
    if turned:
        return scores.select("token", F.when(F.min(x).over(whole) < 0, F.max(x).over(whole) + 1 - x).otherwise(x).alias("weight"))
    inv = scores.select("token", F.try_divide(F.lit(1.0), 1 + x).alias("w"))
    return inv.select("token", F.when(F.min("w").over(whole) < 0, F.exp(F.col("w") - F.max("w").over(whole))).otherwise(F.col("w")).alias("weight"))


def optimise_weights(costs: DataFrame, steps: int = 30, ridge_: float = 1.0, rate: float = 0.5) -> DataFrame:
    """Rows (token, w, weight) that lessen the sum over messages of their weighted mean cost, for rows (id, token, cost).

    A token's weight is logistic in w, and w has a ridge penalty. Each step is one gradient over all rows, summed by token in a shuffle, with a step size of each token's
    own (by the root of its squared gradients so far); w is written between steps, so lineage stays short.
    """
    from .. import shared

    spark = costs.sparkSession
    costs = costs.select("id", "token", F.col("cost").cast("double").alias("cost"))
    kind = costs.schema["token"].dataType.simpleString()
    now = costs.select("token").distinct().select("token", F.lit(0.0).alias("w"), F.lit(0.0).alias("sq"))
    for _ in range(steps):
        rows = costs.join(now.select("token", (1 / (1 + F.exp(-F.col("w")))).alias("s")), "token")
        sums = rows.groupBy("id").agg(F.sum("s").alias("ws"), F.sum(F.col("s") * F.col("cost")).alias("wc"))
        part = F.col("s") * (1 - F.col("s")) * (F.col("cost") * F.col("ws") - F.col("wc")) / F.pow("ws", 2)
        grad = rows.join(sums, "id").groupBy("token").agg(F.sum(part).alias("g"))
        g = F.coalesce("g", F.lit(0.0)) + ridge_ * F.col("w")
        new = now.join(grad, "token", "left").select("token", "w", "sq", g.alias("g")).withColumn("sq", F.col("sq") + F.col("g") * F.col("g"))
        new = new.select("token", (F.col("w") - rate * F.try_divide(F.col("g"), F.sqrt("sq") + 1e-12)).alias("w"), "sq")
        path = shared.path(spark, "weights")
        new.write.parquet(path)
        now = spark.read.schema(f"token {kind}, w double, sq double").parquet(path)
    return now.select("token", "w", (1 / (1 + F.exp(-F.col("w")))).alias("weight"))


def weighted_cost(costs: DataFrame, weights: DataFrame) -> DataFrame:
    """The sum over messages of their weighted mean cost."""
    rows = costs.join(weights.select("token", "weight"), "token")
    return rows.groupBy("id").agg((F.sum(F.col("weight") * F.col("cost")) / F.sum("weight")).alias("c")).agg(F.sum("c").alias("total"))


def pooled_points(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (id, lon, lat): all points of all tokens of each message."""
    return messages.distinct().join(points, "token").select("id", "lon", "lat")


def pooled_means(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (id, n, lon, lat): number and means of each message's pooled points, from sums by token, so that no point is ever joined with a message."""
    sums = points.groupBy("token").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("lon", "lat") for k, f in (("n", F.count), ("s", F.sum))])
    mean = {c: F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(c) for c in ("lon", "lat")}
    return messages.distinct().join(sums, "token").groupBy("id").agg(F.sum("n").alias("n"), mean["lon"], mean["lat"])


def locate_kde(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (id, lon, lat, n): of each message's pooled points that where a normal kernel density of them is highest (bandwidth by Scott's rule). Leave out frequent tokens before."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        p = df.sort_values(["lon", "lat"])[["lon", "lat"]].to_numpy(float)
        n = len(p)
        best = p[0]
        if n > 2:
            cov = np.cov(p.T) * n ** (-1 / 3) + np.eye(2) * 1e-9
            inv = np.linalg.inv(cov)
            d = np.empty(n)
            for lo in range(0, n, 512):
                diff = p[lo : lo + 512, None] - p[None]
                d[lo : lo + 512] = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", diff, inv, diff)).sum(1)
            best = p[int(d.argmax())]
        return pd.DataFrame([(df.id.iloc[0], best[0], best[1], n)], columns=["id", "lon", "lat", "n"])

    kind = messages.schema["id"].dataType.simpleString()
    return pooled_points(messages, points).groupBy("id").applyInPandas(one, f"id {kind}, lon double, lat double, n long")


def locate_everywhere(messages: DataFrame, points: DataFrame) -> DataFrame:
    """The same place for every message: the mean of all points."""
    return messages.select("id").distinct().crossJoin(F.broadcast(points.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))))


def locate_fixed(messages: DataFrame, lon: float, lat: float, fail: int = 7) -> DataFrame:
    """One given place for every message but one in ``fail`` (by hash), which isn't located."""
    rows = messages.select("id").distinct()
    return (rows.where(F.pmod(F.xxhash64("id"), F.lit(fail)) != 0) if fail else rows).withColumns({"lon": F.lit(lon), "lat": F.lit(lat)})


def locate_oracle(truth: DataFrame) -> DataFrame:
    """The true place."""
    return truth.select("id", F.col("true_lon").alias("lon"), F.col("true_lat").alias("lat"))


def first_of(*located: DataFrame) -> DataFrame:
    """Each message's place by the first of several models that has one."""
    out = located[0].select("id", "lon", "lat")
    for more in located[1:]:
        out = out.unionByName(more.select("id", "lon", "lat").join(out.select("id"), "id", "left_anti"))
    return out


def locate(messages: DataFrame, models: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Best points (id, lon, lat) of messages of (id, token): components of known tokens pooled, those under ``floor`` of the heaviest left out."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("id")
    both = messages.distinct().join(models, "token").withColumn("_max", F.max("weight").over(w)).where(F.col("weight") > F.col("_max") * floor)
    return both.groupBy("id").agg((F.sum(F.col("weight") * F.col("lon")) / F.sum("weight")).alias("lon"), (F.sum(F.col("weight") * F.col("lat")) / F.sum("weight")).alias("lat"), F.count("*").alias("components"))


def category_distance(parents: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """Levels up from two articles until their category sets meet (``most`` if they don't): edges (child, parent), pairs (a, b).

    Each level is a join with what the last one found first, written to the shared folder, so cycles and repeated paths add nothing.
    """
    from .. import shared

    spark = parents.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    parents = parents.select("child", "parent").distinct()
    front = pairs.select(F.col("a").alias("root")).union(pairs.select("b")).distinct().select("root", F.col("root").alias("node"))
    seen = None
    for d in range(1, most + 1):
        new = front.join(parents, F.col("node") == F.col("child")).select("root", F.col("parent").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["root", "node"], "left_anti")
        path = shared.path(spark, "levels")
        new.withColumn("d", F.lit(d)).write.parquet(path)
        level = spark.read.schema(f"root {kind}, node {kind}, d int").parquet(path)
        seen = level if seen is None else seen.union(level)
        front = level.select("root", "node")
        if level.isEmpty():
            break
    x = seen.select(F.col("root").alias("a"), "node", F.col("d").alias("x"))
    y = seen.select(F.col("root").alias("b"), "node", F.col("d").alias("y"))
    met = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "node"]).groupBy("a", "b").agg(F.min(F.greatest("x", "y")).alias("distance"))
    return pairs.select("a", "b").distinct().join(met, ["a", "b"], "left").select("a", "b", F.coalesce("distance", F.lit(most)).alias("distance"))
