"""Confidence intervals, resampling, clipping and point-pattern statistics beyond the basic ones.

Intervals that need quantiles of beta or gamma distributions are computed by
vectorised bisection on the incomplete integrals, on the distinct pairs of counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles, running_total
from .stats import binomial_interval, clip_bounds, close_pairs, poisson_interval, value_counts

_STEPS = 80


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta integral, by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    turn = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
            h = h * c * d
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))) / p
    got = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(turn, 1 - got, got)


def gamma_cdf(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma integral: a series below a + 1, a continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    term = 1 / a
    total = term.copy()
    for k in range(1, 2000):
        term = term * x / (a + k)
        total = total + term
        if np.all(term <= 1e-16 * total):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        low = total * np.exp(a * np.log(x) - x - _lgamma(a))
    return np.where(x <= 0, 0.0, np.clip(low, 0, 1))


def _quantile(cdf, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    for _ in range(_STEPS):
        mid = (low + high) / 2
        below = cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.broadcast_to(p, np.shape(a)).astype(float)
    return _quantile(lambda x: beta_cdf(x, a, b), p, np.zeros_like(p), np.ones_like(p))


def gamma_quantile(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    p = np.broadcast_to(p, np.shape(a)).astype(float)
    return _quantile(lambda x: gamma_cdf(x, a), p, np.zeros_like(p), a + 12 * np.sqrt(a) + 60)


_BOUNDS = "low double, high double"


def binomial_bounds(k: Column, n: Column, level: float = 0.682689492, kind: str = "wilson") -> Column:
    """A struct (low, high) for the share k of n: wilson, wald, jeffreys or flat. Null where n is 0 or null, or k isn't within 0..n."""
    ok = (n > 0) & (k >= 0) & (k <= n)
    if kind in ("wilson", "wald"):
        z = _normal_quantile(0.5 + level / 2)
        low, high = binomial_interval(k, n, z, kind)
        return F.when(ok, F.struct(low.alias("low"), high.alias("high")))
    if kind not in ("jeffreys", "flat"):
        raise ValueError(f"unknown interval {kind!r}")
    more = 0.5 if kind == "jeffreys" else 1.0
    tail = (1 - level) / 2

    @F.pandas_udf(_BOUNDS)
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        a, b = ks.to_numpy(float), ns.to_numpy(float)
        fine = (b > 0) & (a >= 0) & (a <= b)
        x, y = np.where(fine, a, 0) + more, np.where(fine, b - a, 0) + more
        low, high = beta_quantile(tail, x, y), beta_quantile(1 - tail, x, y)
        if kind == "jeffreys":
            low, high = np.where(a == 0, 0.0, low), np.where(a == b, 1.0, high)
        return pd.DataFrame({"low": low, "high": high})

    return F.when(ok, bounds(k.cast("double"), n.cast("double")))


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def shortest_interval(n: int, background: float, level: float, cells: int = 20_000) -> tuple[float, float]:
    """The shortest interval of a signal over a known background that holds ``level`` of its likelihood, by counting the cells of a fine grid from the likeliest on."""
    top = max(n - background, 0) + 12 * math.sqrt(n + 1) + 20
    s = np.linspace(0, top, cells + 1)
    mu = s + background
    with np.errstate(divide="ignore"):
        log = n * np.log(mu) - mu if n else -mu
    w = np.exp(log - log.max())
    w /= w.sum()
    order = np.argsort(-w, kind="stable")
    inside = order[: int(np.searchsorted(np.cumsum(w[order]), level)) + 1]
    return float(s[inside.min()]), float(s[inside.max()])


def poisson_bounds(n: Column, kind: str = "root-n", sigma: float = 1.0, background: float = 0.0, level: float | None = None) -> Column:
    """A struct (low, high) for a count: root-n, root-n-0, pearson, sherpagehrels, frequentist-confidence or kraft-burrows-nousek (with a background and a level)."""
    if kind in ("root-n", "root-n-0", "pearson"):
        low, high = poisson_interval(n, sigma, kind)
        return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    if kind == "sherpagehrels":
        h = sigma * (1 + F.sqrt(n + 0.75))
        return F.struct((n - h).alias("low"), (n + h).alias("high"))
    if kind == "frequentist-confidence":
        tail = 1 - normal_cdf(sigma)

        @F.pandas_udf(_BOUNDS)
        def exact(s: pd.Series) -> pd.DataFrame:
            x = s.fillna(0).to_numpy(float)
            low = np.where(x > 0, gamma_quantile(tail, np.maximum(x, 1)), 0.0)
            return pd.DataFrame({"low": low, "high": gamma_quantile(1 - tail, x + 1)})

        return F.when(n.isNotNull(), exact(n.cast("double")))
    if kind == "kraft-burrows-nousek":
        held = level if level is not None else 1 - 2 * (1 - normal_cdf(sigma))

        @F.pandas_udf(_BOUNDS)
        def shortest(s: pd.Series) -> pd.DataFrame:
            got = {x: shortest_interval(int(x), background, held) for x in s.dropna().unique()}
            return pd.DataFrame([got.get(x, (None, None)) for x in s], columns=["low", "high"])

        return F.when(n.isNotNull(), shortest(n.cast("double")))
    raise ValueError(f"unknown interval {kind!r}")


def kuiper_two(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (d, n, m): Kuiper's statistic of two samples, each the non-null values of a column."""
    long = df.select(F.explode(F.array(F.struct(a.cast("double").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(b.cast("double").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s")).select("s.*")
    c = long.where("x is not null and not isnan(x)").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    r = running_total(c, [F.asc("x")], {"ca": "a", "cb": "b"}, {"n": "a", "m": "b"})
    gap = F.col("ca") / F.col("n") - F.col("cb") / F.col("m")
    return r.agg((F.greatest(F.max(gap), F.lit(0.0)) + F.greatest(F.max(-gap), F.lit(0.0))).alias("d"), F.max("n").alias("n"), F.max("m").alias("m"))


def kuiper_probability(d: Column, n: Column, terms: int = 30) -> Column:
    """How likely uniform values give a statistic of at least d: the asymptotic series with the small-sample factor."""
    lam2 = F.pow((F.sqrt(n) + 0.155 + 0.24 / F.sqrt(n)) * d, F.lit(2))
    total = sum((2 * (4 * j * j * lam2 - 1) * F.exp(-2 * j * j * lam2) for j in range(1, terms + 1)), F.lit(0.0))
    return F.when(lam2 < 0.16, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def v_test(df: DataFrame, angle: Column, mean: float, by: list[str]) -> DataFrame:
    """(by..., n, v, p): the Rayleigh test of uniform angles against a known mean direction."""
    x = df.select(*by, F.cos(angle.cast("double") - mean).alias("c")).where("c is not null and not isnan(c)")
    a = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("c").alias("v"))

    @F.pandas_udf("double")
    def p(v: pd.Series, n: pd.Series) -> pd.Series:
        z = v.to_numpy(float) * np.sqrt(2 * n.to_numpy(float))
        upper = np.array([1 - normal_cdf(x) for x in z])
        m = n.to_numpy(float)
        tail = (3 * z - z**3) / (16 * m) + (15 * z + 305 * z**3 - 125 * z**5 + 9 * z**7) / (4608 * m * m)
        return pd.Series(upper + np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * tail)

    return a.withColumn("p", p("v", "n"))


def circular_moment(df: DataFrame, angle: Column, p: int, by: list[str], centred: bool = False, weight: Column | None = None) -> DataFrame:
    """(by..., angle, length): the p-th trigonometric moment, about the mean direction if ``centred``, with weights if given."""
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    x = df.select(*by, angle.cast("double").alias("x"), w.alias("w")).where("x is not null and not isnan(x) and w is not null")
    if centred:
        mean = x.groupBy(*by).agg(F.atan2(F.sum(F.col("w") * F.sin("x")), F.sum(F.col("w") * F.cos("x"))).alias("m"))
        x = (x.join(mean, by) if by else x.join(F.broadcast(mean))).withColumn("x", F.col("x") - F.col("m"))
    a = x.groupBy(*by).agg(F.sum(F.col("w") * F.cos(F.col("x") * p)).alias("c"), F.sum(F.col("w") * F.sin(F.col("x") * p)).alias("s"), F.sum("w").alias("t"))
    return a.select(*by, F.atan2("s", "c").alias("angle"), F.try_divide(F.hypot("c", "s"), "t").alias("length"))


def sigma_clip(df: DataFrame, column: str, lower: float = 3.0, upper: float | None = None, rounds: int = 5, centre: str = "median") -> DataFrame:
    """The rows with ``clipped`` (outside of the last bounds, null or NaN), ``clip_low`` and ``clip_high``.

    Each round works on the counts of distinct values, which are written once.
    """
    upper = lower if upper is None else upper
    low, high = clip_bounds(value_counts(df, column), lower, upper, rounds, centre)
    x = F.col(column).cast("double")
    out = x.isNull() | F.isnan(x) | (x < low) | (x > high)
    return df.withColumn("clipped", F.coalesce(out, F.lit(True))).withColumn("clip_low", F.lit(low)).withColumn("clip_high", F.lit(high))


def bin_edges(df: DataFrame, column: str, bins: int | list[float], low: float | None = None, high: float | None = None) -> DataFrame:
    """One row (edges): equal bins over the range of the column or the given one, or given edges as they are."""
    if not isinstance(bins, int):
        return df.sparkSession.createDataFrame([([float(b) for b in bins],)], "edges array<double>")
    s = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a is not null")
    a = F.lit(float(low)) if low is not None else F.col("a")
    z = F.lit(float(high)) if high is not None else F.col("z")
    return s.select(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: a + (z - a) * i / bins).alias("edges"))


def jackknife(df: DataFrame, column: str, statistic: str = "mean", by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """(by..., estimate, bias, std_err, low, high) of mean, var or std: what leaving out one row gives follows from three sums, so no sample is made."""
    by = by or []
    x = df.select(*by, F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    s = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    y = (x.join(s, by) if by else x.join(F.broadcast(s))).where("n > 2")
    n, d = F.col("n"), F.col("x") - F.col("m")
    # without one row: the mean moves by d / (n - 1), the sum of squares falls by d^2 n / (n - 1)
    mean, var = F.col("m") - d / (n - 1), (n * F.col("v") - d * d * n / (n - 1)) / (n - 1)
    whole = {"mean": F.col("m"), "var": F.col("v"), "std": F.sqrt("v")}[statistic]
    y = y.withColumn("loo", {"mean": mean, "var": var, "std": F.sqrt(F.greatest(var, F.lit(0.0)))}[statistic]).withColumn("whole", whole)
    a = y.groupBy(*by).agg(F.max("n").alias("n"), F.max("whole").alias("whole"), F.avg("loo").alias("l"), F.var_pop("loo").alias("w"))
    bias = (n - 1) * (F.col("l") - F.col("whole"))
    err = F.sqrt((n - 1) * F.col("w"))
    z = _normal_quantile(0.5 + level / 2)
    est = F.col("whole") - bias
    return a.select(*by, est.alias("estimate"), bias.alias("bias"), err.alias("std_err"), (est - z * err).alias("low"), (est + z * err).alias("high"))


def jackknife_samples(df: DataFrame, key: str, column: str, by: str) -> DataFrame:
    """(by, left_out, n, total, mean): the leave-one-out sample of every row of a group, as its sums."""
    x = df.where(F.col(column).isNotNull())
    s = x.groupBy(by).agg(F.count("*").alias("_n"), F.sum(column).alias("_t"))
    y = x.join(s, by).where("_n > 1")
    total = F.col("_t") - F.col(column)
    return y.select(by, F.col(key).alias("left_out"), (F.col("_n") - 1).alias("n"), total.alias("total"), (total / (F.col("_n") - 1)).alias("mean"))


def bootstrap(df: DataFrame, column: str, key: str, statistic: str = "mean", replicates: int = 50) -> DataFrame:
    """(replicate, value) of mean, var or sum: Poisson weights drawn from a hash of key and replicate; sums combine before the shuffle."""
    x = df.select(F.col(key).cast("string").alias("k"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    u = F.pmod(F.xxhash64("k", "replicate"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    edges, p, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += p
        edges.append(total)
        p /= k
    w = sum((F.col("u") >= e).cast("int") for e in edges)
    y = x.select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("u", u).withColumn("w", w)
    s = y.groupBy("replicate").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("t"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    mean = F.try_divide("t", "n")
    value = {"mean": mean, "sum": F.col("t"), "var": F.try_divide("q", "n") - mean * mean}[statistic]
    return s.select("replicate", value.alias("value"))


def ripley(df: DataFrame, key: str, x: Column, y: Column, radii: list[float], box: tuple[float, float, float, float], mode: str = "none") -> DataFrame:
    """(radius, k) of points in a box (x_min, y_min, x_max, y_max): pairs closer than the radius, without edge correction, weighted by the overlap of shifted boxes (translation), or from points farther from the edge than the radius (var-width).

    Close pairs are summed cell by cell (``stats.close_pairs``).
    """
    x0, y0, x1, y1 = box
    area = (x1 - x0) * (y1 - y0)
    p = df.select(F.col(key).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    edge = F.least(x1 - F.col("x"), y1 - F.col("y"), F.col("x") - x0, F.col("y") - y0)
    a = p.select(edge.alias("edge"))
    got = close_pairs(p, radii, box, mode)
    one = a.agg(F.count("*").alias("n"), *[F.sum((F.col("edge") > r).cast("long")).alias(f"e{i}") for i, r in enumerate(radii)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"r{i}").alias("m"), F.col(f"e{i}").alias("e")) for i, r in enumerate(radii)]))
    g = got.join(F.broadcast(one)).select("n", rows.alias("s")).select("n", "s.*")
    n = F.col("n")
    k = {
        "none": area * F.try_divide(F.col("m"), n * (n - 1)),
        "translation": area**2 * F.try_divide(F.col("m"), n * (n - 1)),
        "var-width": area * F.try_divide(F.when(F.col("e") > 0, F.col("m") / F.col("e")).otherwise(F.col("m")), n),
    }[mode]
    return g.select("radius", k.alias("k"))


def quantile_sigmas(df: DataFrame, column: str) -> DataFrame:
    """One row: median and half the distance of the quantiles that hold 68.27 % of a normal distribution."""
    q = quantiles(df, column, {"low": 0.158655, "median": 0.5, "high": 0.841345})
    return q.select("median", ((F.col("high") - F.col("low")) / 2).alias("sigma"))
