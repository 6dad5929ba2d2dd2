"""Event series: counting, months, densifying, resampling, normalising, correlating, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import strings as S


def hourly(events: DataFrame, project: str, article: str, ts: str, value: Column | None = None) -> DataFrame:
    """Counts (project, article, hour, v), summed before the shuffle."""
    return events.groupBy(F.col(project).cast("string").alias("project"), F.col(article).cast("string").alias("article"), F.date_trunc("hour", ts).alias("hour")).agg((F.sum(value) if value is not None else F.count("*")).cast("double").alias("v"))


def hourly_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From page-count lines (project, url, hour, count): each article's count at an hour, of repeated lines the largest, and each project's total over all lines."""
    articles = lines.groupBy("project", F.col("url").alias("article"), "hour").agg(F.max("count").cast("double").alias("v"))
    return articles, lines.groupBy("project", "hour").agg(F.sum("count").cast("double").alias("total"))


def totals(series: DataFrame) -> DataFrame:
    """Project totals by hour; hours without lines have no row."""
    return series.groupBy("project", "hour").agg(F.sum("v").alias("total"))


def fragments(series: DataFrame, shards: int, threshold: float = 0.0) -> DataFrame:
    """One row a series and month: shard, total of absolute values (kept from ``threshold`` on) and the dense hour vector.

    Hours are summed into places of a day's array, and days laid out in a month's, after one shuffle.
    """
    name = F.concat_ws("+", "project", "article")
    g = series.select(name.alias("name"), N.month_of(F.col("hour")).alias("fragment"), F.dayofmonth("hour").alias("d"), F.hour("hour").alias("h"), "v").repartition("name", "fragment")
    day = F.array(*[F.coalesce(F.sum(F.when(F.col("h") == h, F.col("v"))), F.lit(0.0)) for h in range(24)])
    g = g.groupBy("name", "fragment", "d").agg(F.sum(F.abs("v")).alias("t"), day.alias("hours"))
    g = g.groupBy("name", "fragment").agg(F.sum("t").alias("total"), F.map_from_entries(F.collect_list(F.struct("d", "hours"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), 24)
    dense = F.flatten(F.transform(F.sequence(F.lit(1), F.dayofmonth(F.last_day("fragment"))), lambda d: F.coalesce(F.try_element_at("m", d), zeros)))
    return g.where(F.col("total") >= threshold).select("name", "fragment", N.shard(F.col("name"), shards).alias("shard"), "total", dense.alias("data"))


def fetch(frags: DataFrame, *names: str) -> DataFrame:
    """Sparse rows (name, ts, v) of the named series over the stored months."""
    rows = frags.where(F.col("name").isin(*names)) if names else frags
    return rows.select("name", "fragment", F.posexplode("data").alias("h", "v")).select("name", (F.col("fragment").cast("timestamp") + F.make_dt_interval(hours=F.col("h"))).alias("ts"), "v")


def drop_latest_only(frags: DataFrame) -> DataFrame:
    """Without series whose only month is the latest."""
    latest = frags.agg(F.max("fragment").alias("latest"))
    w = Window.partitionBy("name")
    rows = frags.crossJoin(F.broadcast(latest)).withColumn("n", F.count("*").over(w))
    return rows.where(~((F.col("n") == 1) & (F.col("fragment") == F.col("latest")))).drop("n", "latest")


def _steps(df: DataFrame, time: str, step: str) -> Column | None:
    """How many steps a time is after ``_lo``; None where steps aren't all of one length (months, and days of time stamps)."""
    n, unit = step.split() if len(step.split()) == 2 else ("", "")
    kind, unit = df.schema[time].dataType.simpleString(), unit.upper().rstrip("S")
    if n.isdecimal() and int(n) and kind == "date" and unit in ("DAY", "WEEK"):
        return F.datediff(time, "_lo") / (int(n) * (7 if unit == "WEEK" else 1))
    if n.isdecimal() and int(n) and kind == "timestamp" and unit in ("HOUR", "MINUTE", "SECOND"):
        return (F.unix_micros(time) - F.unix_micros("_lo")) / (int(n) * {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit] * 1000000)
    return None


def densify(df: DataFrame, keys: list[str], time: str, step: str, fill: dict[str, object], per_key: bool = True) -> DataFrame:
    """A row for every step between the first and last time, of each key or of all; absent values take ``fill``.

    Only the rows that there are move: each makes, once its key's rows are together, the steps up to the next one. (Steps whose length varies, as months, are joined.)
    """
    span = [F.min(time).alias("_lo"), F.max(time).alias("_hi")]
    axis = F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))
    place = _steps(df, time, step)
    if place is None:
        axes = df.groupBy(*keys).agg(*span) if per_key else df.select(*keys).distinct().crossJoin(F.broadcast(df.agg(*span)))
        out = axes.select(*keys, F.explode(axis).alias(time)).join(df, [*keys, time], "left")
    else:
        w = Window.partitionBy(*keys)
        rows = df.withColumns({"_lo": F.min(time).over(w), "_hi": F.max(time).over(w)}) if per_key else df.crossJoin(F.broadcast(df.agg(*span)))
        # rows that are on no step, or of a null key, stand for no value but still for their key
        on = F.col(time).isNotNull() & (place % 1 == 0)
        for k in keys:
            on = on & F.col(k).isNotNull()
        order = w.orderBy(F.desc("_on"), time)
        rows = rows.withColumn("_on", F.coalesce(on, F.lit(False)))
        rows = rows.withColumns({"_i": F.row_number().over(order), "_next": F.lead(F.when(F.col("_on"), F.col(time))).over(order)}).where("_on or _i = 1")
        one = F.expr(f"INTERVAL {step}")
        first = F.when(F.col("_i") == 1, F.col("_lo")).otherwise(F.col(time))
        last = F.when(F.col("_on") & F.col("_next").isNotNull(), F.greatest(F.col(time), (F.col("_next") - one).cast(df.schema[time].dataType))).otherwise(F.col("_hi"))
        others = [c for c in df.columns if c not in keys and c != time]
        rows = rows.select(*keys, F.explode(F.sequence(first, last, one)).alias("_t"), F.col("_on"), F.col(time).alias("_own"), *others)
        here = F.col("_on") & (F.col("_t") == F.col("_own"))
        out = rows.select(*keys, F.col("_t").alias(time), *[F.when(here, F.col(c)).alias(c) for c in others])
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if v is not None})


def resample(df: DataFrame, keys: list[str], time: str, value: str, unit: str) -> DataFrame:
    """Sums by hour, day, week (Monday), week-sat (Sunday to Saturday) or month; a bucket of nulls stays null."""
    bucket = N.week_saturday(F.col(time)) if unit == "week-sat" else F.date_trunc(unit, time)
    return df.groupBy(*keys, bucket.alias(time)).agg(F.sum(value).alias(value))


def normalise(df: DataFrame, total: DataFrame, on: list[str], value: str = "v", by: str = "total", parts: float = 1e6) -> DataFrame:
    """Parts (a million) of the total; null where that is absent or 0."""
    return df.join(total, on, "left").withColumn("norm", F.try_divide(F.col(value) * parts, F.col(by)))


def pearson(a: Column, b: Column, least: int = 3, default: float | None = 0.0) -> Column:
    """Correlation over rows where both are known: ``default`` for fewer than ``least`` or no variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    r = F.when(F.sum(F.when(both, 1).otherwise(0)) >= least, r)
    return F.coalesce(r, F.lit(default)) if default is not None else r


def correlate(series: DataFrame, targets: DataFrame, on: str, keys: list[str], value: str = "v", target: str = "y") -> DataFrame:
    """Every series against every target on shared times, with masked extremes; targets are few and their rows are joined by time."""
    both = series.join(targets, on)
    ok = F.col(target).isNotNull()
    return both.groupBy(*keys, "target").agg(pearson(F.col(value), F.col(target)).alias("r"), F.max(F.when(ok, F.col(value))).alias("peak"), F.min(F.when(ok, F.col(value))).alias("trough"))


def correlate_sparse(series: DataFrame, targets: DataFrame, on: str, keys: list[str], value: str = "v", target: str = "y", least: int = 3) -> DataFrame:
    """As ``correlate`` for series that are 0 where they have no row: from sums over their rows and each target's own sums, so that no zero is ever a row."""
    ok = targets.where(F.col(target).isNotNull())
    y = F.col(target)
    own = ok.groupBy("target").agg(F.count("*").alias("_n"), F.sum(y).alias("_sy"), F.sum(y * y).alias("_syy"))
    v = F.col(value)
    sums = series.join(ok, on).groupBy(*keys, "target").agg(F.count("*").alias("_k"), F.sum(v).alias("_sv"), F.sum(v * v).alias("_svv"), F.sum(v * y).alias("_svy"), F.max(v).alias("_hi"), F.min(v).alias("_lo"))
    both = sums.join(own, "target")
    n = F.col("_n").cast("double")
    cov = F.col("_svy") - F.col("_sv") * F.col("_sy") / n
    var = (F.col("_svv") - F.col("_sv") * F.col("_sv") / n) * (F.col("_syy") - F.col("_sy") * F.col("_sy") / n)
    r = F.when((n >= least) & (var > 1e-9 * F.col("_svv") * F.col("_syy")), F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))))
    gaps = F.col("_k") < n
    extremes = F.when(gaps, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")), F.when(gaps, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    return both.select(*keys, "target", F.coalesce(r, F.lit(0.0)).alias("r"), extremes[0].alias("peak"), extremes[1].alias("trough"))


def similar(found: DataFrame, min_peak: float, min_similarity: float) -> DataFrame:
    """Correlations with a peak and an absolute r large enough."""
    return found.where((F.col("peak") >= min_peak) & (F.abs("r") >= min_similarity))


def parts_per(counts: DataFrame, totals: DataFrame, keys: list[str], day: str, value: str = "n", total: str = "total", parts: float = 1e6, enough: float = 0.0) -> DataFrame:
    """Every key on every day of its project's totals: parts (a million) of the total, 0 without counts, null on masked days (a total under ``enough``)."""
    axis = counts.select(*keys).distinct().join(totals, [k for k in keys if k in totals.columns]) if any(k in totals.columns for k in keys) else counts.select(*keys).distinct().crossJoin(totals)
    rows = axis.join(counts, [*keys, day], "left")
    share = F.try_divide(F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * parts, F.col(total))
    return rows.select(*keys, day, F.when(F.col(total) >= enough, share).alias("ppm"))


def zero_fraction(df: DataFrame, keys: list[str], time: str, value: str, axis: int, most: float) -> DataFrame:
    """Keys with their share of zeros among ``axis`` times (absent rows are zeros), where it is at most ``most``."""
    some = df.groupBy(*keys).agg((1 - F.count(F.when(F.col(value) != 0, 1)) / axis).alias("zeros"))
    return some.where(F.col("zeros") <= most)


def align(estimate: DataFrame, truth: DataFrame, keys: list[str], time: str, days: int = 0, how: str = "right") -> DataFrame:
    """Estimates moved ``days`` later on the truth's times: all of them ("right"), or those in both ("inner")."""
    moved = estimate.withColumn(time, F.date_add(time, days))
    return moved.join(truth, [*keys, time], how)


def side_by_side(predictions: DataFrame, time: str, now: str, nows: list, value: str) -> DataFrame:
    """A column of predictions for each of ``nows``."""
    return predictions.groupBy(time).pivot(now, nows).agg(F.first(value))


def test_schedule(spark, start: str, limit: str, train: str, gap: str, test: str, stride: str) -> DataFrame:
    """Windows of training, gap and test, moved by ``stride`` while the test ends before ``limit``."""
    s = F.expr(f"explode(sequence(TIMESTAMP '{start}', TIMESTAMP '{limit}', INTERVAL {stride}))").alias("train_start")
    rows = spark.range(1).select(s)
    rows = rows.withColumn("train_end", F.expr(f"train_start + INTERVAL {train}")).withColumn("test_start", F.expr(f"train_end + INTERVAL {gap}")).withColumn("test_end", F.expr(f"test_start + INTERVAL {test}"))
    return rows.where(F.col("test_end") < F.lit(limit).cast("timestamp"))


def training_window(df: DataFrame, keys: list[str], time: str, nows: DataFrame, training: int) -> DataFrame:
    """For every ``now`` (a position) the rows of each key at positions [now - training, now)."""
    rows = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    wide = nows.select("now", F.explode(F.sequence(F.col("now") - training, F.col("now") - 1)).alias("position"))
    return rows.join(wide, "position")


def gains(df: DataFrame, keys: list[str], model: str, base: str, errors: list[str], similarities: list[str]) -> DataFrame:
    """Each model against the base model of its keys: base error over error, and (1 - base) over (1 - own) of similarities; null where that is over 0."""
    own = df.where(F.col(model) == base).select(*keys, *[F.col(c).alias(f"_{c}") for c in (*errors, *similarities)])
    both = df.join(own, keys)
    ratio = [F.try_divide(f"_{c}", c).alias(c) for c in errors] + [F.try_divide(1 - F.col(f"_{c}"), 1 - F.col(c)).alias(c) for c in similarities]
    return both.select(*keys, model, *ratio)


def resize(df: DataFrame, time: str, value: str, first: str, last: str) -> DataFrame:
    """Rows of every day from ``first`` to ``last``: those outside are cut off, absent ones are 0; none if the bounds are crossed."""
    spark = df.sparkSession
    if first > last:
        return df.select(time, value).limit(0)
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(time))
    inside = df.where(F.col(time).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return axis.join(inside, time, "left").select(time, F.coalesce(value, F.lit(0.0)).alias(value))


def trim_for_fit(df: DataFrame, target: str, columns: list[str], least: float, rows: int) -> DataFrame:
    """Rows with a target and at least ``least`` of the columns neither null nor 0; an error (when it runs) if fewer than ``rows`` are left."""
    good = sum((F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, 1).otherwise(0) for c in columns), F.lit(0))
    kept = df.where(F.col(target).isNotNull() & (good >= least * len(columns)))
    n = kept.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") >= rows, F.lit(True)).otherwise(F.raise_error(F.lit("too few rows left")).cast("boolean")).alias("_ok"))
    return kept.crossJoin(F.broadcast(n)).where("_ok").drop("_ok")


def metrics_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums of numeric columns and the same divided by the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"{c}_sum") for c in columns], *[(F.sum(c) / F.count("*")).alias(f"{c}_mean") for c in columns])


def select_slices(df: DataFrame, keys: list[str], order: list[Column], text: str) -> DataFrame:
    """The rows of each key whose places in the order are in the slices of ``text``."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_place": F.row_number().over(w.orderBy(*order)) - 1, "_total": F.count("*").over(w)})
    return rows.where(S.slices(text, F.col("_place"), F.col("_total"))).drop("_place", "_total")


def sample_hash(df: DataFrame, key: str, fraction: float | None = None, n: int | None = None, seed: int = 1) -> DataFrame:
    """A repeatable sample by a hash of the key that any engine can compute: each row with probability ``fraction``, or exactly ``n`` rows."""
    h = N.portable_hash(F.col(key), seed)
    if fraction is not None:
        return df.where(h % 1000003 < int(fraction * 1000003))
    return df.orderBy(h, key).limit(n)


def mix_noise(df: DataFrame, keys: list[str], time: str, value: str, share: float, seed: int) -> DataFrame:
    """(1 - share) of each value and ``share`` of another of its series, by a random permutation."""
    a = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    b = df.select(*keys, F.col(value).alias("_other"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(time, F.lit(seed)), time)).alias("_i"))
    return a.join(b, [*keys, "_i"]).withColumn(value, (1 - share) * F.col(value) + share * F.col("_other")).drop("_i", "_other")


def lagged(series: DataFrame, targets: DataFrame, on: str, keys: list[str], lags: range, value: str = "v", target: str = "y") -> DataFrame:
    """Correlation at every lag in days, the target shifted later by the lag."""
    shifts = targets.select("*", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    moved = shifts.withColumn(on, F.date_add(on, F.col("lag")))
    return series.join(moved, on).groupBy(*keys, "lag").agg(pearson(F.col(value), F.col(target)).alias("r"), F.count("*").alias("n"))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def trim_head(df: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """Without the ``share`` (rounded up) of rows of largest count, ties by key: whole counts fall by a histogram of counts, only the count at the cut is ranked."""
    hist = df.groupBy(count).agg(F.count("*").alias("_rows"))
    hist = hist.withColumn("_above", F.sum("_rows").over(Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)))
    cut = df.agg(F.ceil(F.count("*") * share).alias("_cut"))
    hist = hist.crossJoin(F.broadcast(cut)).select(count, (F.col("_cut") - F.coalesce("_above", F.lit(0))).alias("_left"), "_rows")
    rows = df.join(hist.where("_left < _rows"), count)
    at = rows.where("_left > 0").withColumn("_rank", F.row_number().over(Window.partitionBy(count).orderBy(key))).where("_rank > _left")
    return rows.where("_left <= 0").select(*df.columns).unionByName(at.select(*df.columns))


def mapping(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct pairs of a mapping, and whether each side has one partner only."""
    rows = df.distinct()
    one = lambda c: F.count("*").over(Window.partitionBy(*keys, c)) == 1
    return rows.withColumns({"unique_a": one(a), "unique_b": one(b)})


def combinations(df: DataFrame, name: str, most: int) -> DataFrame:
    """Sorted arrays ``names`` of all combinations of 1 to ``most`` of the (few) names."""
    base = df.select(F.col(name).alias("_n")).distinct()
    now = base.select(F.array("_n").alias("names"))
    out = now
    for _ in range(most - 1):
        now = now.join(base, F.element_at("names", -1) < F.col("_n")).select(F.array_append("names", F.col("_n")).alias("names"))
        out = out.union(now)
    return out


def interpolate(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Inner nulls linear between neighbours, outer ones 0, on a dense axis."""
    w = Window.partitionBy(*keys).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.unix_timestamp(F.col(time).cast("timestamp")))
    df = df.withColumns({"_t": F.unix_timestamp(F.col(time).cast("timestamp")), "_v0": F.last(value, True).over(back), "_t0": F.last(known, True).over(back), "_v1": F.first(value, True).over(ahead), "_t1": F.first(known, True).over(ahead)})
    mid = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide((F.col("_t") - F.col("_t0")).cast("double"), (F.col("_t1") - F.col("_t0")).cast("double"))
    return df.withColumn(value, F.coalesce(F.col(value), mid, F.lit(0.0))).drop("_t", "_v0", "_t0", "_v1", "_t1")


def intervals(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Values at irregular dates spread evenly over the days up to the next date (the last has one day)."""
    w = Window.partitionBy(*keys).orderBy(day)
    nxt = F.coalesce(F.lead(day).over(w), F.date_add(day, 1))
    rows = df.withColumn("_n", nxt)
    return rows.select(*keys, F.explode(F.sequence(F.col(day), F.date_sub("_n", 1))).alias("day"), (F.col(value) / F.datediff("_n", day)).alias(value))


def hit_rate(df: DataFrame, keys: list[str], time: str, estimate: str, truth: str) -> DataFrame:
    """Share of consecutive pairs in which both move the same way."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.withColumns({"_e": F.signum(F.col(estimate) - F.lag(estimate).over(w)), "_r": F.signum(F.col(truth) - F.lag(truth).over(w))})
    return d.where("_e is not null and _r is not null").groupBy(*keys).agg(F.avg((F.col("_e") == F.col("_r")).cast("int")).alias("hit_rate"))


def schedule(spark, length: int, training: int, horizon: int, stride: int) -> DataFrame:
    """Rolling origins: ``now`` from training + horizon on, by stride."""
    return spark.range(0, max(length - horizon, 0), stride).where(F.col("id") >= training + horizon).select(F.col("id").cast("int").alias("now"))


def folds(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Contiguous folds of each key; the first ones get one row more if need be."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(*keys).orderBy(order)))


def persistence(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The last value as the prediction; the first predicts itself."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("prediction", F.coalesce(F.lag(value).over(w), F.col(value)))
