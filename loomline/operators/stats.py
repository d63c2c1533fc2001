"""Robust, circular and resampling statistics, histograms and intervals.

All are aggregates: nulls and NaN are left out, a group without values gives no
row, and quantiles are exact with linear interpolation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import quantiles, running_total


def _values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    x = df.select(*by, F.col(column).cast("double").alias("x"))
    return x.where("x is not null and not isnan(x)")


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.join(F.broadcast(right))  # without groups the right side is one row


def centred(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Values with their group's median and median absolute deviation."""
    x = _values(df, column, by)
    x = _join(x, quantiles(x, "x", {"med": 0.5}, by), by)
    mad = quantiles(x.withColumn("dev", F.abs(F.col("x") - F.col("med"))), "dev", {"mad": 0.5}, by)
    return _join(x, mad, by)


def mad_std(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., n, median, mad, mad_std): the deviation scaled to a normal distribution's sigma."""
    return centred(df, column, by).groupBy(*by).agg(F.count("*").alias("n"), F.first("med").alias("median"), F.first("mad").alias("mad")).withColumn("mad_std", F.col("mad") * 1.482602218505602)


def biweight(df: DataFrame, column: str, by: list[str], c_location: float = 6.0, c_scale: float = 9.0) -> DataFrame:
    """(by..., biweight_location, biweight_midvariance, biweight_scale). Without spread the location is the median and the variance 0."""
    x = centred(df, column, by)
    d = F.col("x") - F.col("med")
    u = lambda c: F.try_divide(d, F.col("mad") * c)
    uu = {k: F.pow(u(c), 2) for k, c in (("l", c_location), ("s", c_scale))}
    inside = lambda k, e: F.sum(F.when(uu[k] < 1, e).otherwise(0.0))
    a = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("med").alias("med"), F.first("mad").alias("mad"),
        inside("l", d * F.pow(1 - uu["l"], 2)).alias("ld"), inside("l", F.pow(1 - uu["l"], 2)).alias("lw"),
        inside("s", d * d * F.pow(1 - uu["s"], 4)).alias("sd"), inside("s", (1 - uu["s"]) * (1 - 5 * uu["s"])).alias("sw"),
    )
    loc = F.when(F.col("mad") == 0, F.col("med")).otherwise(F.col("med") + F.try_divide("ld", "lw"))
    var = F.when(F.col("mad") == 0, 0.0).otherwise(F.try_divide(F.col("n") * F.col("sd"), F.pow("sw", F.lit(2))))
    return a.select(*by, loc.alias("biweight_location"), var.alias("biweight_midvariance"), F.sqrt(var).alias("biweight_scale"))


def biweight_midcorrelation(df: DataFrame, a: str, b: str, c: float = 9.0) -> DataFrame:
    """One row: biweight midcovariance and midcorrelation of two columns, over rows that have both."""
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    q = both
    for v in ("a", "b"):
        q = q.join(F.broadcast(quantiles(both, v, {f"m_{v}": 0.5})))
    for v in ("a", "b"):
        dev = q.withColumn("dev", F.abs(F.col(v) - F.col(f"m_{v}")))
        q = q.join(F.broadcast(quantiles(dev, "dev", {f"mad_{v}": 0.5})))
    d = {v: F.col(v) - F.col(f"m_{v}") for v in ("a", "b")}
    uu = {v: F.pow(F.try_divide(d[v], F.col(f"mad_{v}") * c), 2) for v in ("a", "b")}
    num = {v: F.when(uu[v] < 1, d[v] * F.pow(1 - uu[v], 2)).otherwise(0.0) for v in ("a", "b")}
    den = {v: F.sum(F.when(uu[v] < 1, (1 - uu[v]) * (1 - 5 * uu[v])).otherwise(0.0)) for v in ("a", "b")}
    s = q.agg(F.count("*").alias("n"), F.sum(num["a"] * num["b"]).alias("ab"), F.sum(num["a"] * num["a"]).alias("aa"), F.sum(num["b"] * num["b"]).alias("bb"), den["a"].alias("da"), den["b"].alias("db"))
    return s.select(F.try_divide(F.col("n") * F.col("ab"), F.col("da") * F.col("db")).alias("midcovariance"), F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("midcorrelation"))


def circular(df: DataFrame, angle: Column, by: list[str]) -> DataFrame:
    """(by..., n, circmean, circvar, circstd, angular_std, moment2_angle, moment2_length, rayleigh_p, vonmises_kappa) of angles in radians."""
    x = df.select(*by, angle.cast("double").alias("x")).where("x is not null and not isnan(x)")
    c = lambda p: F.avg(F.cos(F.col("x") * p))
    s = lambda p: F.avg(F.sin(F.col("x") * p))
    a = x.groupBy(*by).agg(F.count("*").alias("n"), c(1).alias("c"), s(1).alias("s"), c(2).alias("c2"), s(2).alias("s2")).where("n > 0")
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    a = a.withColumn("r", r)
    z = F.col("n") * F.col("r") ** 2
    n = F.col("n")
    small = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n)
    k = F.col("r")
    kappa = F.when(k < 0.53, 2 * k + k**3 + 5 * k**5 / 6).when(k < 0.85, -0.4 + 1.39 * k + F.try_divide(F.lit(0.43), 1 - k)).otherwise(F.try_divide(F.lit(1.0), k**3 - 4 * k**2 + 3 * k))
    return a.select(
        *by, "n", F.atan2("s", "c").alias("circmean"), (1 - k).alias("circvar"), F.sqrt(-2 * F.log("r")).alias("circstd"), F.sqrt(2 * (1 - k)).alias("angular_std"),
        F.atan2("s2", "c2").alias("moment2_angle"), F.sqrt(F.col("c2") ** 2 + F.col("s2") ** 2).alias("moment2_length"),
        (F.exp(-z) * F.when(n < 50, small).otherwise(1.0)).alias("rayleigh_p"), kappa.alias("vonmises_kappa"),
    )


def circular_correlation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: the circular correlation coefficient of two angle columns."""
    x = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where("a is not null and b is not null")
    m = x.agg(F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a"))).alias("ma"), F.atan2(F.avg(F.sin("b")), F.avg(F.cos("b"))).alias("mb"))
    y = x.join(F.broadcast(m))  # one row
    sa, sb = F.sin(F.col("a") - F.col("ma")), F.sin(F.col("b") - F.col("mb"))
    return y.agg(F.try_divide(F.sum(sa * sb), F.sqrt(F.sum(sa * sa) * F.sum(sb * sb))).alias("circcorr"))


def histogram(df: DataFrame, column: str, rule: str | int = "freedman") -> DataFrame:
    """(bin, low, high, n) with empty bins; ``rule`` is scott, freedman or a number of equal bins. The last bin is closed.

    A table whose values are all equal has one bin.
    """
    x = _values(df, column, [])
    s = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("sd")).where("n > 0")
    if rule == "freedman":
        q = quantiles(x, "x", {"q1": 0.25, "q3": 0.75})
        s = s.join(F.broadcast(q)).withColumn("dx", 2 * (F.col("q3") - F.col("q1")) / F.pow("n", F.lit(1 / 3)))
    elif rule == "scott":
        s = s.withColumn("dx", 3.5 * F.col("sd") / F.pow("n", F.lit(1 / 3)))
    else:
        s = s.withColumn("dx", (F.col("hi") - F.col("lo")) / int(rule))
    bins = F.greatest(F.lit(1), F.ceil(F.col("hi") / F.col("dx") - F.col("lo") / F.col("dx"))) if rule in ("scott", "freedman") else F.lit(int(rule))
    s = s.withColumn("bins", F.when(F.col("dx") > 0, bins).otherwise(1).cast("int")).select("lo", "dx", "bins")
    counts = x.join(F.broadcast(s)).select(F.least(F.col("bins") - 1, F.when(F.col("dx") > 0, F.floor((F.col("x") - F.col("lo")) / F.col("dx"))).otherwise(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = s.select("lo", "dx", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("dx")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("dx")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(x, n) of the distinct values of a column, written once: what follows reads these instead of the table."""
    return materialise(_values(df, column, []).groupBy("x").agg(F.count("*").alias("n")), "values")


def clip_bounds(counted: DataFrame, lower: float, upper: float, rounds: int, centre: str = "median") -> tuple[float, float]:
    """The bounds that are left after repeatedly leaving out values farther from the centre than so many deviations; a round sends its few sums to the driver."""
    low, high, before = -math.inf, math.inf, None
    for _ in range(rounds):
        kept = counted.where((F.col("x") >= low) & (F.col("x") <= high))
        s = kept.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("x")), F.sum("n")).alias("m")).first()
        if not s.n or s.n == before:
            break
        before = s.n
        spread = kept.agg(F.sum(F.col("n") * F.pow(F.col("x") - s.m, F.lit(2))).alias("q")).first().q
        sd = math.sqrt(max(0.0, spread / s.n))
        mid = _middle(kept, s.n) if centre == "median" else s.m
        low, high = mid - lower * sd, mid + upper * sd
    return low, high


def _middle(counted: DataFrame, n: int) -> float:
    """The median of n counted values."""
    seq = running_total(counted, [F.asc("x")], {"hi": "n"})
    r = seq.agg(*[F.min(F.when(F.col("hi") > k, F.col("x"))).alias(f"m{i}") for i, k in enumerate(((n - 1) // 2, n // 2))]).first()
    return (r.m0 + r.m1) / 2


def sigma_clipped_stats(df: DataFrame, column: str, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """One row (mean, median, std, n) after repeatedly leaving out values farther than sigma deviations from the median."""
    counted = value_counts(df, column)
    low, high = clip_bounds(counted, sigma, sigma, rounds)
    kept = counted.where((F.col("x") >= low) & (F.col("x") <= high))
    n = F.sum("n")
    one = kept.agg(F.sum(F.col("n") * F.col("x")).alias("t"), n.alias("n")).where("n > 0").select((F.col("t") / F.col("n")).alias("mean"), "n")
    spread = kept.join(F.broadcast(one.select("mean"))).agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("q"))
    total = one.first()
    median = _middle(kept, total.n) if total else None
    return one.join(F.broadcast(spread)).select("mean", F.sqrt(F.col("q") / F.col("n")).alias("std"), "n", F.lit(median).cast("double").alias("median"))


def jackknife_mean(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., estimate, bias, std_err) of the mean: leave-one-out means follow from the total, so no resample is made."""
    by = by or []
    x = _values(df, column, by)
    s = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum("x").alias("t"))
    y = _join(x, s, by).where("n > 1").withColumn("loo", (F.col("t") - F.col("x")) / (F.col("n") - 1))
    a = y.groupBy(*by).agg(F.first("n").alias("n"), F.first("t").alias("t"), F.avg("loo").alias("m"), F.var_pop("loo").alias("v"))
    mean = F.col("t") / F.col("n")
    return a.select(*by, (mean - (F.col("n") - 1) * (F.col("m") - mean)).alias("estimate"), ((F.col("n") - 1) * (F.col("m") - mean)).alias("bias"), F.sqrt((F.col("n") - 1) * F.col("v")).alias("std_err"))


def bootstrap_mean(df: DataFrame, column: str, key: str, replicates: int = 50) -> DataFrame:
    """(replicate, mean): Poisson bootstrap. Weights are drawn from a hash of key and replicate, so the result doesn't hang on partitioning; sums combine before the shuffle."""
    x = df.select(F.col(key).cast("string").alias("k"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    u = F.pmod(F.xxhash64("k", "replicate"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    edges, p, total = [], math.exp(-1), 0.0
    for k in range(1, 12):
        total += p
        edges.append(total)
        p /= k
    w = sum((F.col("u") >= e).cast("int") for e in edges)
    y = x.select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("u", u).withColumn("w", w)
    return y.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("mean"))


def binomial_interval(k: Column, n: Column, z: float = 1.0, kind: str = "wilson") -> tuple[Column, Column]:
    """Bounds of the confidence interval of a proportion k of n: wilson or wald."""
    p = F.try_divide(k, n)
    if kind == "wald":
        h = z * F.sqrt(p * (1 - p) / n)
        return p - h, p + h
    mid = (k + z * z / 2) / (n + z * z)
    h = z * F.sqrt(n) / (n + z * z) * F.sqrt(p * (1 - p) + z * z / (4 * n))
    return F.greatest(mid - h, F.lit(0.0)), F.least(mid + h, F.lit(1.0))


def binned_binomial(df: DataFrame, x: Column, success: Column, lo: float, hi: float, bins: int, z: float = 1.0) -> DataFrame:
    """(bin, n, p, low, high) of the successes by bin of x; x outside of [lo, hi] is left out."""
    v = df.select(x.cast("double").alias("x"), success.cast("int").alias("k")).where(F.col("x").between(lo, hi) & F.col("k").isNotNull())
    b = v.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / (hi - lo) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    low, high = binomial_interval(F.col("k"), F.col("n"), z)
    return b.select("bin", "n", (F.col("k") / F.col("n")).alias("p"), low.alias("low"), high.alias("high"))


def poisson_interval(n: Column, sigma: float = 1.0, kind: str = "root-n") -> tuple[Column, Column]:
    """Bounds for a Poisson count: root-n, root-n-0 (a count of 0 has width 1) or pearson."""
    if kind == "pearson":
        h = sigma * F.sqrt(n + 0.25 * sigma * sigma)
        return n + 0.5 * sigma * sigma - h, n + 0.5 * sigma * sigma + h
    h = F.sqrt(n)
    if kind == "root-n-0":
        h = F.when(n == 0, 1.0).otherwise(h)
    return n - sigma * h, n + sigma * h


def kuiper(df: DataFrame, column: Column) -> DataFrame:
    """One row (d, n): Kuiper's statistic of values in [0, 1) against the uniform distribution."""
    c = df.select(column.cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count("*").alias("c"))
    r = running_total(c, [F.asc("x")], {"hi": "c"}, {"n": "c"})
    up, down = F.max(F.col("hi") / F.col("n") - F.col("x")), F.max(F.col("x") - (F.col("hi") - F.col("c")) / F.col("n"))
    return r.agg((up + down).alias("d"), F.max("n").alias("n"))


def information_criteria(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, ssr, bic, aic) of the least-squares line of y on x, with the small-sample correction below 40 rows a parameter."""
    v = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    a = v.agg(F.count("*").alias("n"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    ssr = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    n, k = F.col("n"), 2.0
    a = a.withColumn("ssr", ssr)
    fit = n * F.log(F.col("ssr") / n)
    aic = fit + 2 * k + F.when(n / k < 40, F.try_divide(F.lit(2 * k * (k + 1)), n - k - 1)).otherwise(0.0)
    return a.select("n", "ssr", (fit + k * F.log(n)).alias("bic"), aic.alias("aic"))


#: Points of a cell that meet others at once.
POINTS = 512


def _reach(r: float, inclusive: bool) -> float:
    """The largest squared distance whose root is below the radius, or at most the radius."""
    meets = (lambda v: math.sqrt(v) <= r) if inclusive else (lambda v: math.sqrt(v) < r)
    v = r * r
    while meets(v):
        v = math.nextafter(v, math.inf)
    while v >= 0 and not meets(v):
        v = math.nextafter(v, -math.inf)
    return v


def close_pairs(p: DataFrame, radii: list[float], box: tuple[float, float, float, float], mode: str = "none", inclusive: bool = False) -> DataFrame:
    """One row (r0, r1, ...): for each radius the pairs of points (id, x, y) with different ids that are closer, each counted in both orders.

    The mode translation weighs a pair by the overlap of shifted boxes, var-width
    counts it from points farther from the edge than the radius. Equal points
    are one with a count. Points meet those of their own cell, as wide as the
    largest radius, and of four neighbouring cells, in vector arithmetic;
    rows with the same id are taken off again.
    """
    x0, y0, x1, y1 = box
    top, own_box = max(radii), (x1 - x0, y1 - y0)
    reach = [_reach(r, inclusive) for r in radii]
    edge = F.least(F.lit(x1) - F.col("x"), F.lit(y1) - F.col("y"), F.col("x") - x0, F.col("y") - y0)
    inf = float("inf")
    q = p.where(F.col("id").isNotNull() & F.col("x").between(-1.7e308, 1.7e308) & F.col("y").between(-1.7e308, 1.7e308))
    points = q.groupBy("x", "y").agg(F.count("*").alias("n"))
    cells = points.select("x", "y", "n", F.floor((F.col("x") - x0) / top).alias("cx"), F.floor((F.col("y") - y0) / top).alias("cy"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    cells = cells.withColumn("d", F.explode(near))
    cells = cells.select(F.lit(None).cast("string").alias("same"), (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"), "x", "y", "n")
    # ids that occur again, each in a cell of its own, whose pairs count against the others
    again = q.join(q.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id"), "id")
    again = again.groupBy(F.col("id").cast("string").alias("same"), "x", "y").agg(F.count("*").alias("n"))
    again = again.select("same", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(True).alias("own"), "x", "y", "n")
    every = cells.unionByName(again).withColumn("edge", edge)

    def pairs(a: tuple, b: tuple, later: np.ndarray | None) -> np.ndarray:
        """Sums over the pairs of two sets of points, sorted by y; ``later`` lets through one order of a set's own pairs."""
        ax, ay, an, ae = (v[:, None] for v in a)
        bx, by, bn, be = b
        dx, dy = ax - bx, ay - by
        v = dx * dx + dy * dy
        ones = an.max() == 1 and bn.max() == 1
        if mode == "translation":
            with np.errstate(divide="ignore"):  # pairs as far apart as the box, beyond any radius
                w = 1 / ((own_box[0] - np.abs(dx)) * (own_box[1] - np.abs(dy)))
        out = np.zeros(len(radii))
        for i, t in enumerate(reach):
            m = v <= t
            if later is not None:
                m &= later
            if mode == "translation":
                out[i] = 2 * (an[:, 0] @ (np.where(m, w, 0.0) @ bn))
            elif mode == "var-width":
                far, out_far = ae[:, 0] > radii[i], be > radii[i]
                out[i] = (an[:, 0] * far) @ (m @ bn) + an[:, 0] @ (m @ (bn * out_far))
            else:
                out[i] = 2 * (np.count_nonzero(m) if ones else an[:, 0] @ (m @ bn))
        return out

    def cell(batch: pa.Table) -> pa.Table:
        same = batch.column("same")[0].as_py() is not None
        own, x, y, n, e = (batch.column(c).to_numpy() for c in ("own", "x", "y", "n", "edge"))
        n = n.astype(float)
        order = np.argsort(y, kind="stable")
        first, rest = order[own[order]], order[~own[order]]
        mine, other = tuple(v[first] for v in (x, y, n, e)), tuple(v[rest] for v in (x, y, n, e))
        # points at the same place are no farther than any radius
        sums = np.zeros(len(radii))
        twice = mine[2] * (mine[2] - 1)
        for i, r in enumerate(radii):
            if reach[i] >= 0:
                each = twice * (mine[3] > r) if mode == "var-width" else twice
                sums[i] = each.sum() / (own_box[0] * own_box[1] if mode == "translation" else 1)
        # a little more than the largest radius, as differences are rounded
        span = inf if same else top * (1 + 1e-9) + 1e-9 * np.abs(y).max(initial=0.0)
        for s in range(0, len(first), POINTS):
            some = tuple(v[s : s + POINTS] for v in mine)
            z = np.searchsorted(mine[1], some[1][-1] + span, "right")
            if z > s + 1:
                sums += pairs(some, tuple(v[s:z] for v in mine), np.arange(z - s)[None, :] > np.arange(len(some[0]))[:, None])
            a, z = np.searchsorted(other[1], some[1][0] - span), np.searchsorted(other[1], some[1][-1] + span, "right")
            for k in range(a, z, 8 * POINTS):
                sums += pairs(some, tuple(v[k : min(z, k + 8 * POINTS)] for v in other), None)
        return pa.table({f"r{i}": [-t if same else t] for i, t in enumerate(sums.tolist())})

    got = every.groupBy("same", "cx", "cy").applyInArrow(cell, ", ".join(f"r{i} double" for i in range(len(radii))))
    return got.agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0.0)).alias(f"r{i}") for i in range(len(radii))])


def ripley_k(df: DataFrame, key: str, x: Column, y: Column, radii: list[float], area: float) -> DataFrame:
    """(radius, k, l, h, poisson) without edge correction."""
    p = df.select(F.col(key).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    got = close_pairs(p, radii, (0.0, 0.0, 1.0, 1.0), inclusive=True)
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"r{i}").alias("m")) for i, r in enumerate(radii)]))
    one = p.agg(F.count("*").alias("n"))
    g = got.select(rows.alias("r")).select("r.*").join(F.broadcast(one))
    k = F.lit(float(area)) * F.try_divide(F.col("m"), F.col("n") * (F.col("n") - 1))
    return g.select("radius", k.alias("k"), F.sqrt(k / math.pi).alias("l"), (F.sqrt(k / math.pi) - F.col("radius")).alias("h"), (math.pi * F.col("radius") ** 2).alias("poisson"))


def softmax(df: DataFrame, group: str, column: str) -> DataFrame:
    """Adds logsumexp, softmax and log_softmax of a column within each group: two aggregates, joined back, so a large group is never in one window."""
    top = df.groupBy(group).agg(F.max(column).alias("_m"))
    x = df.join(top, group)
    lse = x.groupBy(group).agg((F.log(F.sum(F.exp(F.col(column) - F.col("_m")))) + F.first("_m")).alias("logsumexp"))
    return df.join(lse, group).withColumn("softmax", F.exp(F.col(column) - F.col("logsumexp"))).withColumn("log_softmax", F.col(column) - F.col("logsumexp"))


def minmax_scale(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Adds (x - min) / (max - min); a constant column scales to 0."""
    s = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(F.broadcast(s)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(F.col(column).isNotNull(), 0.0))).drop("_lo", "_hi")


def explained_variance(df: DataFrame, component: str, variance: str, target: float) -> DataFrame:
    """(component, ratio, cumulative, reaches) of the variance a component; components are few."""
    w = Window.orderBy(component).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(variance).over(Window.partitionBy(F.lit(1)))
    x = df.select(component, (F.col(variance) / total).alias("ratio"), (F.sum(variance).over(w) / total).alias("cumulative"))
    return x.withColumn("reaches", F.col("cumulative") >= target)
