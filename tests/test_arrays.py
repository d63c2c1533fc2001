"""Array kernels against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import arrays as A

X = [3.0, -1.5, 0.0, 2.0, 2.0, 7.25]
Y = [1.0, 4.0, -2.0, 0.5, 3.0, 2.0]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(X, Y, [], [1, 0, 2, 2, 5])], "x array<double>, y array<double>, e array<double>, k array<int>")


def one(df, c):
    return df.select(c.alias("v")).first().v


a, b = np.array(X), np.array(Y)


def cases():
    x, y, k = F.col("x"), F.col("y"), F.col("k")
    return {
        "mean": (A.mean(x), a.mean()), "var": (A.var(x), a.var()), "stdev": (A.stdev(x), a.std()), "prod": (A.prod(x), a.prod()), "rms": (A.rms(x), np.sqrt((a**2).mean())),
        "norm": (A.norm(x), np.linalg.norm(a)), "ptp": (A.ptp(x), np.ptp(a)), "argmin": (A.argmin(x), a.argmin()), "argmax": (A.argmax(x), a.argmax()), "percentile": (A.percentile(x, 30.0), np.percentile(a, 30)),
        "mode": (A.mode(x), 2.0), "cumsum": (A.cumsum(x), a.cumsum()), "cumprod": (A.cumprod(y), b.cumprod()), "diff": (A.diff(x), np.diff(a)), "gradient": (A.gradient(x), np.gradient(a)), "trapz": (A.trapz(x), np.trapezoid(a)),
        "argsort": (A.argsort(x), np.argsort(a, kind="stable")), "roll": (A.roll(x, 2), np.roll(a, 2)), "roll_back": (A.roll(x, -1), np.roll(a, -1)), "unique": (A.unique(x), np.unique(a)), "union": (A.union1d(x, y), np.union1d(a, b)),
        "intersect": (A.intersect1d(x, y), np.intersect1d(a, b)), "setdiff": (A.setdiff1d(x, y), np.setdiff1d(a, b)), "duplicates": (A.find_duplicates(x), [2.0]), "flatnonzero": (A.flatnonzero(x), np.flatnonzero(a)),
        "digitize": (A.digitize(x, F.array(F.lit(0.0), F.lit(2.0))), np.digitize(a, [0, 2])), "bincount": (A.bincount(k, 6), np.bincount([1, 0, 2, 2, 5])), "trim_zeros": (A.trim_zeros(A.pad(y, 2)), b), "tile": (A.tile(x, 2), np.tile(a, 2)),
        "repeat": (A.repeat(x, 2), np.repeat(a, 2)), "hypot": (A.hypot(x, y), np.hypot(a, b)), "maximum": (A.maximum(x, y), np.maximum(a, b)), "minimum": (A.minimum(x, y), np.minimum(a, b)), "logaddexp": (A.logaddexp(x, y), np.logaddexp(a, b)),
        "cov": (A.cov(x, y), np.cov(a, b, bias=True)[0, 1]), "corrcoef": (A.corrcoef(x, y), np.corrcoef(a, b)[0, 1]), "outer": (A.outer(x, y), np.outer(a, b)), "matmul": (A.matmul(F.array(x, y), x), np.array([a, b]) @ a),
        "cross": (A.cross(F.slice(x, 1, 3), F.slice(y, 1, 3)), np.cross(a[:3], b[:3])), "polyval": (A.polyval(x, F.lit(0.5)), np.polynomial.polynomial.polyval(0.5, a)), "clip": (A.clip(x, -1, 3), a.clip(-1, 3)), "normalize": (A.normalize(x), a / np.linalg.norm(a)),
        "linspace": (A.linspace(0, 1, 5), np.linspace(0, 1, 5)), "geomspace": (A.geomspace(1, 16, 5), np.geomspace(1, 16, 5)), "hamming": (A.window("hamming", 6), np.hamming(6)), "hanning": (A.window("hanning", 6), np.hanning(6)),
        "bartlett": (A.window("bartlett", 6), np.bartlett(6)), "blackman": (A.window("blackman", 6), np.blackman(6)), "sinc": (A.apply(x, "sinc"), np.sinc(a)), "trunc": (A.apply(x, "trunc"), np.trunc(a)), "take": (A.take(x, [2, 0]), a[[2, 0]]),
        "searchsorted": (A.searchsorted(A.sort(x), F.lit(2.0)), np.searchsorted(np.sort(a), 2.0)), "gcd": (A.gcd(F.lit(84), F.lit(-36)), 12), "lcm": (A.lcm(F.lit(4), F.lit(6)), 12), "allclose": (A.allclose(x, x), True), "count_nonzero": (A.count_nonzero(x), 5),
    }


def test_against_numpy(row):
    all_of = cases()
    got = row.select(*[c.alias(n) for n, (c, _) in all_of.items()]).first().asDict()
    assert [n for n, (_, want) in all_of.items() if not np.allclose(got[n], want)] == []


def test_empty_and_missing(spark, row):
    e = F.col("e")
    assert one(row, A.mean(e)) is None and one(row, A.median(e)) is None and one(row, A.total(e)) == 0 and one(row, A.argmax(e)) is None
    assert one(row, A.roll(e, 3)) == [] and one(row, A.diff(e)) == [] and one(row, A.cumsum(e)) == []
    odd = spark.createDataFrame([([1.0, None, float("nan"), 4.0],), (None,)], "v array<double>")
    got = [tuple(r) for r in odd.select(A.nansum(F.col("v")), A.nanmean(F.col("v")), A.nanmedian(F.col("v")), A.nanstdev(F.col("v"))).collect()]
    assert got[0] == (5.0, 2.5, 2.5, 1.5) and got[1][1] is None
