"""Hashes, arithmetic, dates and geodesy as column expressions."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.009


def _bytes(c: Column) -> Column:
    h = F.hex(F.encode(c, "utf-8"))
    n = F.length(h) / 2
    codes = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(n > 0, codes).otherwise(F.array().cast("array<bigint>"))


def fnv1a_32(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    return F.aggregate(_bytes(c), F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(b) * 16777619 % 4294967296)


def djb2(c: Column) -> Column:
    """32-bit djb2, XOR variant, of the UTF-8 bytes."""
    return F.aggregate(_bytes(c), F.lit(5381).cast("long"), lambda h, b: (h * 33 % 4294967296).bitwiseXOR(b))


def shard(c: Column, n: int) -> Column:
    return (fnv1a_32(c) % n).cast("int")


def portable_hash(c: Column, seed: int = 1) -> Column:
    """A hash below 2^31 - 1 of a whole number, by arithmetic that any engine has and that can't overflow."""
    low, high = F.pmod(c, F.lit(65536)), F.pmod(F.shiftright(c, 16), F.lit(2147483647))
    return (low * 40503 + high * 65599 + seed * 97) % 2147483647 * 48271 % 2147483647


def consecutive(c: Column, low: float, high: float, n: int) -> Column:
    """Which of n equal bins between low and high."""
    return F.greatest(F.least(F.floor((c - low) / ((high - low) / n)), F.lit(n - 1)), F.lit(0)).cast("int")


def is_power_2(c: Column) -> Column:
    return (c > 0) & (c.bitwiseAND(c - 1) == 0)


def ppm(a: Column, b: Column) -> Column:
    return F.try_divide(a * 1e6, b)


def logistic(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def inverse(f: Column) -> Column:
    return 1 / (1 + f)


def chi2_critical(c: Column) -> Column:
    """Critical value of chi-squared with 2 degrees of freedom at coverage c."""
    return -2 * F.log(1 - c)


def deceptiveness(distance: Column) -> Column:
    """From category distance 1..7 to .05...95."""
    return 0.9 * (distance - 1) / 6 + 0.05


def sphere_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Geodesic distance in km on WGS84 (nearly antipodal points fall back to the sphere)."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    lam0 = np.radians(lon2 - lon1)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lam0.copy()
    for _ in range(100):
        ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        cs = s1 * s2 + c1 * c2 * np.cos(lam)
        sigma = np.arctan2(ss, cs)
        sa = np.divide(c1 * c2 * np.sin(lam), ss, out=np.zeros_like(ss), where=ss > 0)
        ca = 1 - sa**2
        cm = np.where(ca > 1e-12, cs - np.divide(2 * s1 * s2, ca, out=np.zeros_like(ca), where=ca > 1e-12), 0)
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        new = lam0 + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
        done = np.abs(new - lam) < 1e-12
        lam = new
        if done.all():
            break
    uu = ca * (a * a - b * b) / (b * b)
    big = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    small = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    out = b * big * (sigma - ds)
    q = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(lam0 / 2) ** 2
    return np.where(done, out, 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(q, 1))))


@pandas_udf(DoubleType())
def ellipsoid_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(vincenty(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))))


def miller(lon: Column, lat: Column, unit_km: float = 1.0) -> tuple[Column, Column]:
    """Miller cylindrical coordinates in units of ``unit_km``."""
    r = EARTH_KM / unit_km
    return F.radians(lon) * r, 1.25 * F.log(F.tan(F.lit(np.pi / 4) + 0.4 * F.radians(lat))) * r


def mollweide(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mollweide equal-area coordinates in km."""
    phi = np.radians(np.asarray(lat, float))
    t = phi.copy()
    for _ in range(50):
        d = 2 + 2 * np.cos(2 * t)
        t = np.where(d > 1e-12, t - (2 * t + np.sin(2 * t) - np.pi * np.sin(phi)) / np.maximum(d, 1e-12), t)
    return EARTH_KM * 2 * np.sqrt(2) / np.pi * np.radians(lon) * np.cos(t), EARTH_KM * np.sqrt(2) * np.sin(t)


def ring_area(lon: np.ndarray, lat: np.ndarray) -> float:
    """Area in square km of a ring of points."""
    x, y = mollweide(lon, lat)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def in_bounds(lat: Column) -> Column:
    return F.abs(lat) < 89.99


def expected_count(day: Column, table: list[tuple[str, float]], rate: float = 1.0) -> Column:
    """Piecewise linear in the day between (day, value) points, times 100 and ``rate``; an error outside."""
    out = F.raise_error(F.lit("day out of range")).cast("double")
    for (a, x), (b, y) in zip(table, table[1:]):
        span = (dt.date.fromisoformat(b) - dt.date.fromisoformat(a)).days
        out = F.when((day >= F.lit(a).cast("date")) & (day <= F.lit(b).cast("date")), (x + (y - x) * F.datediff(day, F.lit(a).cast("date")) / span) * 100 * rate).otherwise(out)
    return out


def tweet_time(c: Column) -> Column:
    """``Wed Oct 31 12:00:00 +0000 2012`` as a timestamp (UTC session)."""
    return F.to_timestamp(F.concat(F.substring(c, 5, 15), F.lit(" "), F.substring(c, 27, 4)), "MMM dd HH:mm:ss yyyy")


def hour_offset(ts: Column) -> Column:
    """Hours since the start of the month."""
    return ((F.dayofmonth(ts) - 1) * 24 + F.hour(ts)).cast("int")


def hours_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day)) * 24


def month_of(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", ts))


def ordinal_hour(ts: Column) -> Column:
    """Hours since year 1."""
    return (F.unix_date(F.to_date(ts)) + 719163).cast("long") * 24 + F.hour(ts)


def file_hour(name: Column) -> Column:
    """Start of the hour that a ``...-YYYYMMDD-HHMMSS`` file covers; its stamp marks the end."""
    return F.date_trunc("hour", F.to_timestamp(F.regexp_extract(name, r"(\d{8}-\d{6})", 1), "yyyyMMdd-HHmmss")) - F.expr("INTERVAL 1 HOUR")


def week_saturday(ts: Column) -> Column:
    """First day (Sunday) of the week that ends on Saturday."""
    return F.date_sub(F.to_date(F.date_trunc("week", F.date_add(F.to_date(ts), 1))), 1)


def iso_time(c: Column) -> Column:
    """``YYYY-MM-DD``, or with a time after 'T' or a space; a date alone is midnight. Null if it is none of them."""
    return F.try_to_timestamp(F.when(F.length(c) == 10, F.concat(c, F.lit(" 00:00:00"))).otherwise(F.replace(c, F.lit("T"), F.lit(" "))), F.lit("yyyy-MM-dd HH:mm:ss"))


def days_diff(a: Column, b: Column) -> Column:
    """Whole days from a to b; an error if they are times that differ by a part of a day."""
    seconds = F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))
    return F.when(seconds % 86400 == 0, (seconds / 86400).cast("int")).otherwise(F.raise_error(F.lit("not whole days")).cast("int"))


def opens_month(ts: Column) -> Column:
    """Whether a time is the first instant of a month."""
    return (F.dayofmonth(ts) == 1) & (ts == F.date_trunc("day", ts))


def season(day: Column, periods: dict[str, tuple[str, str]]) -> Column:
    """The name of the first period (first and last day) that a day is in; null outside."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(periods.items()):
        out = F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(out)
    return out


def bounds(first: str, last: str, low: str, high: str) -> tuple[Column, Column]:
    """Whether two ranges of days are equal, and whether the first is within the second."""
    return (F.col(first) == F.col(low)) & (F.col(last) == F.col(high)), (F.col(first) >= F.col(low)) & (F.col(last) <= F.col(high))


def scaled_weights(c: Column, key: str) -> tuple[Column, Column]:
    """exp(x - max) and max + 1 - x, by key."""
    from pyspark.sql.window import Window

    top = F.max(c).over(Window.partitionBy(key))
    return F.exp(c - top), top + 1 - c


def ellipse(mean: np.ndarray, cov: np.ndarray, coverage: float = 0.95, points: int = 64) -> np.ndarray:
    """A closed ring of points of equal density that holds ``coverage`` of a 2-d normal."""
    size, axes = np.linalg.eigh(cov)
    t = np.linspace(0, 2 * np.pi, points)
    r = np.sqrt(-2 * np.log(1 - coverage) * np.maximum(size, 0))
    return mean + np.column_stack([r[0] * np.cos(t), r[1] * np.sin(t)]) @ axes.T


def ring_wkt(ring: np.ndarray) -> str:
    """A closed ring as a polygon in text."""
    return "POLYGON((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in ring) + "))"


def weight_deceptiveness(signal: Column, random: Column, systematic: Column) -> tuple[Column, Column, Column]:
    """Total, random and systematic deceptiveness of a feature by its weights: shares of what isn't signal."""
    total = signal + random + systematic
    return F.try_divide(random + systematic, total), F.try_divide(random, total), F.try_divide(systematic, total)
