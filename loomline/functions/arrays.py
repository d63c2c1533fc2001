"""Array kernels as column expressions.

An array column is a vector of one row (give kernels columns, not long
expressions: those with places look the array up for each element); kernels stay in the JVM as higher-order
functions. Null arrays give null; reductions of empty arrays give null, counts
and sums 0. ``nan*`` kernels leave NaN and null out first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def _fold(a: Column, zero: float, step) -> Column:
    return F.aggregate(a, F.lit(float(zero)), lambda s, x: step(s, _d(x)))


def _some(a: Column, value: Column) -> Column:
    return F.when(F.size(a) > 0, value)


def _each(a: Column, value: Column) -> Column:
    """A value of the whole array beside each element: inside a lambda it would be computed for each of them."""
    return F.array_repeat(value, F.size(a))


# reductions
def total(a: Column) -> Column:
    return _fold(a, 0, lambda s, x: s + x)


def prod(a: Column) -> Column:
    return _fold(a, 1, lambda s, x: s * x)


def mean(a: Column) -> Column:
    return _some(a, total(a) / F.size(a))


def var(a: Column) -> Column:
    """Population variance, in two passes."""
    return _some(a, total(F.zip_with(a, _each(a, mean(a)), lambda x, m: (_d(x) - m) * (_d(x) - m))) / F.size(a))


def stdev(a: Column) -> Column:
    return F.sqrt(var(a))


def rms(a: Column) -> Column:
    return _some(a, F.sqrt(_fold(a, 0, lambda s, x: s + x * x) / F.size(a)))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(a, 0, lambda s, x: s + x * x))


def amin(a: Column) -> Column:
    return F.array_min(a)


def amax(a: Column) -> Column:
    return F.array_max(a)


def ptp(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def argmin(a: Column) -> Column:
    """Place of the first least value, from 0."""
    return F.nullif(F.array_position(a, F.array_min(a)), F.lit(0)) - 1


def argmax(a: Column) -> Column:
    return F.nullif(F.array_position(a, F.array_max(a)), F.lit(0)) - 1


def count_nonzero(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x != 0))


def all_true(a: Column) -> Column:
    return F.forall(a, lambda x: x != 0)


def any_true(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def none_true(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def percentile(a: Column, q: float) -> Column:
    """Linear interpolation between the sorted values; q in 0..100."""
    s = F.array_sort(F.transform(a, _d))
    at = F.lit(q / 100.0) * (F.size(a) - 1)
    low = F.element_at(s, (F.floor(at) + 1).cast("int"))
    high = F.element_at(s, (F.ceil(at) + 1).cast("int"))
    return _some(a, low + (high - low) * (at - F.floor(at)))


def median(a: Column) -> Column:
    return percentile(a, 50.0)


def mode(a: Column) -> Column:
    """The most frequent value, the least on ties."""
    counted = F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda x: x == v)).alias("n"), (-_d(v)).alias("m")))
    return _some(a, -F.array_max(counted)["m"])


# running and neighbouring values
def cumsum(a: Column) -> Column:
    run = F.aggregate(a, F.struct(F.array().cast("array<double>").alias("o"), F.lit(0.0).alias("s")), lambda s, x: F.struct(F.array_append(s["o"], s["s"] + _d(x)).alias("o"), (s["s"] + _d(x)).alias("s")))
    return run["o"]


def cumprod(a: Column) -> Column:
    run = F.aggregate(a, F.struct(F.array().cast("array<double>").alias("o"), F.lit(1.0).alias("s")), lambda s, x: F.struct(F.array_append(s["o"], s["s"] * _d(x)).alias("o"), (s["s"] * _d(x)).alias("s")))
    return run["o"]


def diff(a: Column) -> Column:
    n = F.size(a)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: _d(x) - _d(y)))


def gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(a)
    at = lambda i: _d(F.get(a, i))
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i == 0, at(F.lit(1)) - at(F.lit(0))).when(i == n - 1, at(n - 1) - at(n - 2)).otherwise((at(i + 1) - at(i - 1)) / 2)))


def trapz(a: Column, dx: float = 1.0) -> Column:
    return _some(a, dx * (total(a) - (_d(F.get(a, F.lit(0))) + _d(F.get(a, F.size(a) - 1))) / 2))


# order and sets
def sort(a: Column) -> Column:
    return F.array_sort(a)


def argsort(a: Column) -> Column:
    """Places in order of value, ties in order of place."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def flip(a: Column) -> Column:
    return F.reverse(a)


def roll(a: Column, k: int) -> Column:
    n = F.size(a)
    r = F.pmod(F.lit(k), F.greatest(n, F.lit(1)))
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, n - r + 1, r), F.slice(a, 1, n - r)))


def unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def union1d(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect1d(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def setdiff1d(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def find_duplicates(a: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda x: x == v)) > 1))


def flatnonzero(a: Column) -> Column:
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != 0), lambda s: s["i"])


def searchsorted(a: Column, v: Column) -> Column:
    """Values of a sorted array below v."""
    return F.size(F.filter(a, lambda x: x < v))


def digitize(a: Column, edges: Column) -> Column:
    """For each value the number of edges at or below it."""
    return F.transform(a, lambda x: F.size(F.filter(edges, lambda e: e <= x)))


def bincount(a: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.size(F.filter(a, lambda x: x == k)))


def trim_zeros(a: Column) -> Column:
    keep = flatnonzero(a)
    return F.when(F.size(keep) == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, F.array_min(keep) + 1, F.array_max(keep) - F.array_min(keep) + 1))


def tile(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, n)))


def pad(a: Column, n: int, value: float = 0.0) -> Column:
    p = F.array_repeat(F.lit(float(value)), n)
    return F.concat(p, F.transform(a, _d), p)


def take(a: Column, places: list[int]) -> Column:
    return F.array(*[F.get(a, F.lit(i)) for i in places])


# two arrays
def zipped(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(_d(x), _d(y)))


def dot(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def hypot(a: Column, b: Column) -> Column:
    return zipped(a, b, F.hypot)


def maximum(a: Column, b: Column) -> Column:
    return zipped(a, b, F.greatest)


def minimum(a: Column, b: Column) -> Column:
    return zipped(a, b, F.least)


def logaddexp(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


def allclose(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(zipped(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)


def cov(a: Column, b: Column) -> Column:
    """Population covariance."""
    away = lambda v: F.zip_with(v, _each(v, mean(v)), lambda x, m: _d(x) - m)
    return _some(a, dot(away(a), away(b)) / F.size(a))


def corrcoef(a: Column, b: Column) -> Column:
    return F.try_divide(cov(a, b), stdev(a) * stdev(b))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: _d(x) * _d(y)))


def matmul(m: Column, v: Column) -> Column:
    """A matrix (array of rows) times a vector."""
    return F.transform(m, lambda r: dot(r, v))


def cross(a: Column, b: Column) -> Column:
    """The product of two vectors of three."""
    p = lambda i, j: _d(F.get(a, F.lit(i))) * _d(F.get(b, F.lit(j))) - _d(F.get(a, F.lit(j))) * _d(F.get(b, F.lit(i)))
    return F.array(p(1, 2), p(2, 0), p(0, 1))


def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation of one value in a function with sorted places, flat beyond its ends."""
    k = searchsorted(xs, x)
    at = lambda c, i: _d(F.get(c, i))
    inside = at(ys, k - 1) + (at(ys, k) - at(ys, k - 1)) * (_d(x) - at(xs, k - 1)) / (at(xs, k) - at(xs, k - 1))
    return F.when(k == 0, at(ys, F.lit(0))).when(k == F.size(xs), at(ys, F.size(xs) - 1)).otherwise(inside)


def polyval(coefficients: Column, x: Column) -> Column:
    """Coefficients from the constant up."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * _d(x) + _d(c))


# element by element
def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(_d(x), F.lit(float(low))), F.lit(float(high))))


def normalize(a: Column) -> Column:
    return F.zip_with(a, _each(a, norm(a)), lambda x, n: F.try_divide(_d(x), n))


def nan_to_num(a: Column, value: float = 0.0) -> Column:
    return F.transform(a, lambda x: F.when(x.isNull() | F.isnan(_d(x)), F.lit(float(value))).otherwise(_d(x)))


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(_d(x)))


def nansum(a: Column) -> Column:
    return total(present(a))


def nanmean(a: Column) -> Column:
    return mean(present(a))


def nanmedian(a: Column) -> Column:
    return median(present(a))


def nanstdev(a: Column) -> Column:
    return stdev(present(a))


#: Scalar functions applied to each element, by name.
ELEMENTWISE = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "rint": F.rint, "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), "sign": F.signum, "sqrt": F.sqrt, "cbrt": F.cbrt,
    "square": lambda x: x * x, "cube": lambda x: x * x * x, "reciprocal": lambda x: F.try_divide(F.lit(1.0), x), "negative": lambda x: -x, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1,
    "log": F.log, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "deg2rad": F.radians, "rad2deg": F.degrees, "sinc": lambda x: F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "isnan": F.isnan, "isinf": lambda x: F.abs(x) == float("inf"), "wrap": lambda x: x - 2 * math.pi * F.floor((x + math.pi) / (2 * math.pi)),
}


def apply(a: Column, name: str) -> Column:
    f = ELEMENTWISE[name]
    return F.transform(a, lambda x: f(_d(x)))


# makers
def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / max(1, n - 1)))


def geomspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) * F.pow(F.lit((high / low) ** (1 / max(1, n - 1))), i))


def window(kind: str, n: int) -> Column:
    """hamming, hanning, bartlett or blackman weights."""
    m = max(1, n - 1)
    shape = {
        "hamming": lambda i: 0.54 - 0.46 * F.cos(2 * math.pi * i / m), "hanning": lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / m),
        "bartlett": lambda i: 1 - F.abs(2.0 * i / m - 1), "blackman": lambda i: 0.42 - 0.5 * F.cos(2 * math.pi * i / m) + 0.08 * F.cos(4 * math.pi * i / m),
    }[kind]
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: shape(i.cast("double")))


# integers
def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by a fixed number of Euclid's steps, enough for 64 bits."""
    step = lambda s, _: F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(F.try_mod(s["a"], s["b"])).cast("long").alias("b"))
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, i: F.when(s["b"] == 0, s).otherwise(step(s, i)))
    return F.when(a.isNotNull() & b.isNotNull(), end["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a) / gcd(a, b)).cast("long") * F.abs(b))
