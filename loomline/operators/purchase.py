"""Purchase models over customer summaries: fitting, expectations, paths, and generators.

The beta-geometric model: purchases come at a gamma-distributed rate, and after
each one a customer leaves with a beta-distributed chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clv import periods, probability_alive
from .modeling import _hyp2f1


@dataclass
class Purchases:
    """Parameters of the beta-geometric model: rate shape r and scale alpha, leaving chance a and b."""

    r: float
    alpha: float
    a: float
    b: float


def log_likelihood(p: Purchases, x: np.ndarray, tx: np.ndarray, t: np.ndarray, weight: np.ndarray) -> float:
    """The mean log likelihood of summaries (frequency, recency, age)."""
    kinds, at = np.unique(x, return_inverse=True)
    fixed = np.array([math.lgamma(p.r + k) - math.lgamma(p.r) + math.lgamma(p.a + p.b) + math.lgamma(p.b + k) - math.lgamma(p.b) - math.lgamma(p.a + p.b + k) for k in kinds])[at]
    stay = -(p.r + x) * np.log(p.alpha + t)
    with np.errstate(divide="ignore"):
        left = np.where(x > 0, np.log(p.a) - np.log(np.maximum(p.b + x - 1, 1e-9)) - (p.r + x) * np.log(p.alpha + tx), -np.inf)
    return float(np.average(fixed + p.r * math.log(p.alpha) + np.logaddexp(stay, left), weights=weight))


def _simplex(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 800) -> np.ndarray:
    """A minimum by reflecting, stretching and shrinking a simplex."""
    points = [start, *(start + 0.5 * e for e in np.eye(len(start)))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10:
            break
        mid = np.mean(points[:-1], axis=0)
        way = mid - points[-1]
        new, far = mid + way, mid + 2 * way
        v = f(new)
        if v < values[0]:
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (new, v)
        elif v < values[-2]:
            points[-1], values[-1] = new, v
        else:
            near = mid - 0.5 * way
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]


def fit_purchases(summary: DataFrame, key: str = "customer", rows: int = 50_000, penalty: float = 0.001) -> Purchases:
    """The likeliest parameters for a summary table, fitted on at most about ``rows`` customers chosen by a hash of the key; equal summaries are counted, not repeated."""
    x = summary.where("frequency >= 0 and recency >= 0 and t >= recency")
    n = x.count()
    if not n:
        raise ValueError("no customers to fit on")
    cut = 1 << 20 if n <= rows else max(1, (1 << 20) * rows // n)
    some = x.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < cut).groupBy("frequency", "recency", "t").agg(F.count("*").alias("w")).limit(2 * rows)
    d = some.toPandas().astype(float).sort_values(["frequency", "recency", "t"])
    f, tx, t, w = (d[c].to_numpy() for c in ("frequency", "recency", "t", "w"))
    scale = 1.0 / max(1.0, float(t.max()))

    def loss(z: np.ndarray) -> float:
        v = np.exp(np.clip(z, -15, 15))
        return -log_likelihood(Purchases(*v), f, tx * scale, t * scale, w) + penalty * float(np.sum(z * z))

    r, alpha, a, b = np.exp(_simplex(loss, np.zeros(4)))
    return Purchases(float(r), float(alpha / scale), float(a), float(b))


def expected_new(t: Column, p: Purchases) -> Column:
    """Purchases expected of a new customer by time t."""

    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        x = np.maximum(s.to_numpy(float), 0)
        z = x / (p.alpha + x)
        series = _hyp2f1(p.r, np.full_like(z, p.b), p.a + p.b - 1, z)
        return pd.Series((p.a + p.b - 1) / (p.a - 1) * (1 - (p.alpha / (p.alpha + x)) ** p.r * series))

    return f(t.cast("double"))


def expected_more(ahead: Column, frequency: Column, recency: Column, age: Column, p: Purchases) -> Column:
    """Purchases expected of a customer with a history within ``ahead``."""

    @F.pandas_udf("double")
    def f(h: pd.Series, x: pd.Series, tx: pd.Series, t: pd.Series) -> pd.Series:
        h, x, tx, t = (s.to_numpy(float) for s in (h, x, tx, t))
        z = h / (p.alpha + t + h)
        out = np.ones_like(z)
        term = np.ones_like(z)
        for k in range(5000):
            term = term * (p.r + x + k) * (p.b + x + k) / (p.a + p.b + x - 1 + k) / (k + 1) * z
            out += term
            if np.max(np.abs(term), initial=0) < 1e-12 * np.max(np.abs(out), initial=1):
                break
        gain = 1 - ((p.alpha + t) / (p.alpha + t + h)) ** (p.r + x) * out
        top = (p.a + p.b + x - 1) / (p.a - 1) * gain
        gone = np.where(x > 0, p.a / np.maximum(p.b + x - 1, 1e-9) * ((p.alpha + t) / (p.alpha + tx)) ** (p.r + x), 0)
        return pd.Series(top / (1 + gone))

    return f(*(c.cast("double") for c in (ahead, frequency, recency, age)))


#: Periods of a month by the unit of a summary (fixed values).
PER_MONTH = {"week": 4.345, "month": 1.0, "day": 30.0, "hour": 720.0}


def customer_value(summary: DataFrame, expected: Callable[[Column], Column], months: int = 12, rate: float = 0.01, unit: str = "day", key: str = "customer") -> DataFrame:
    """(customer, clv): the money of a purchase times the purchases expected in each coming month, discounted by month. ``expected`` gives purchases within a number of units ahead."""
    step = PER_MONTH[unit]
    total = F.lit(0.0)
    for m in range(1, months + 1):
        gain = expected(F.lit(m * step)) - (expected(F.lit((m - 1) * step)) if m > 1 else F.lit(0.0))
        total = total + F.col("monetary_value") * gain / (1 + rate) ** m
    return summary.select(key, total.alias("clv"))


def alive_path(df: DataFrame, customer: str, at: str, p: Purchases, unit: str = "week", end: Column | None = None) -> DataFrame:
    """(customer, period, frequency, recency, t, alive) for every period of a customer's life up to the last of the table: the probability to be still active, as history stood then.

    Periods without purchases are filled in by each customer's own sequence.
    """
    days = {"day": 1, "week": 7}[unit]
    own = periods(df, customer, at, None, unit).select("customer", "period")
    stop = own.agg(F.max("period").alias("stop")) if end is None else df.sparkSession.range(1).select(F.date_trunc(unit, end).cast("date").alias("stop"))
    life = own.groupBy("customer").agg(F.min("period").alias("first"), F.array_sort(F.collect_set("period")).alias("seen")).join(F.broadcast(stop))
    steps = F.sequence("first", "stop", F.expr(f"interval {days} days"))
    x = life.select("customer", "first", "seen", F.explode(steps).alias("period"))
    before = F.filter("seen", lambda d: d <= F.col("period"))
    x = x.select("customer", "period", (F.size(before) - 1).alias("frequency"), (F.datediff(F.array_max(before), "first") / days).alias("recency"), (F.datediff("period", "first") / days).alias("t"))
    return x.withColumn("alive", probability_alive(F.col("frequency"), F.col("recency"), F.col("t"), p.r, p.alpha, p.a, p.b))


def expected_cumulative(df: DataFrame, customer: str, at: str, expected: Callable[[Column], Column], unit: str = "week") -> DataFrame:
    """(period, actual, predicted): cumulative repeat purchases of a calendar, and what a model expects: for every period, over the cohorts first seen before it, their size times the expectation of their age.

    Cohorts and periods are as many as the calendar has periods, whatever the number of customers.
    """
    days = {"day": 1, "week": 7}[unit]
    own = periods(df, customer, at, None, unit).select("customer", "period")
    first = own.groupBy("customer").agg(F.min("period").alias("first"))
    cohorts = first.groupBy("first").agg(F.count("*").alias("size"))
    repeat = own.join(first, "customer").where(F.col("period") > F.col("first")).groupBy("period").agg(F.count("*").alias("n"))
    span = own.agg(F.min("period").alias("a"), F.max("period").alias("z")).where("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "z", F.expr(f"interval {days} days"))).alias("period"))
    grown = calendar.join(F.broadcast(cohorts), F.col("first") < F.col("period"), "left").withColumn("e", F.col("size") * expected(F.coalesce(F.datediff("period", "first"), F.lit(0)) / days))
    predicted = grown.groupBy("period").agg(F.coalesce(F.sum(F.when(F.col("first").isNotNull(), F.col("e"))), F.lit(0.0)).alias("predicted"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    full = predicted.join(repeat, "period", "left").na.fill(0, ["n"])
    return full.select("period", F.sum("n").over(w).alias("actual"), "predicted")


def compare_counts(actual: DataFrame, model: DataFrame, on: str, value: str) -> DataFrame:
    """(on, actual, model): the counts of both where both have the value."""
    return actual.select(on, F.col(value).alias("actual")).join(model.select(on, F.col(value).alias("model")), on)


def gamma_density(x: Column, shape: float, rate: float) -> Column:
    """The density of purchase rates."""
    return F.when(x > 0, F.exp(shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.log(x) - rate * x)).otherwise(0.0)


def beta_density(x: Column, a: float, b: float) -> Column:
    """The density of leaving chances."""
    const = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return F.when((x > 0) & (x < 1), F.exp(const + (a - 1) * F.log(x) + (b - 1) * F.log1p(-x))).otherwise(0.0)


def heterogeneity(spark: SparkSession, p: Purchases, points: int = 100) -> DataFrame:
    """(kind, x, density) of purchase rates, up to the mean and four deviations, and of leaving chances."""
    top = (p.r + 4 * math.sqrt(p.r)) / p.alpha
    i = spark.range(1, points).select((F.col("id") / points).alias("u"))
    rate = i.select(F.lit("rate").alias("kind"), (F.col("u") * top).alias("x")).withColumn("density", gamma_density(F.col("x"), p.r, p.alpha))
    leave = i.select(F.lit("leave").alias("kind"), F.col("u").alias("x")).withColumn("density", beta_density(F.col("x"), p.a, p.b))
    return rate.unionByName(leave)


def generate(spark: SparkSession, model: str, customers: int, t: float, params: dict[str, float], seed: int = 0, log: bool = False) -> DataFrame:
    """Customers drawn from a purchase model, each from a generator of its own, so partitioning doesn't matter: (customer, frequency, recency, t, alive), or with ``log`` their purchases as (customer, at).

    ``model`` is bg (leaves by chance after a purchase), mbg (may also leave right
    after the first one), pareto (leaves at an exponential time; r, alpha, s, beta)
    or bgbb (one possible purchase a period; alpha, beta, gamma, delta). The first
    purchase is at 0; repeat purchases count.
    """
    if model not in ("bg", "mbg", "pareto", "bgbb"):
        raise ValueError(f"unknown model {model!r}")
    q = params

    def one(i: int) -> tuple[list[float], bool]:
        g = np.random.default_rng((seed, int(i)))
        at: list[float] = []
        if model == "bgbb":
            buy, leave = g.beta(q["alpha"], q["beta"]), g.beta(q["gamma"], q["delta"])
            for k in range(1, int(t) + 1):
                if g.random() < leave:
                    return at, False
                if g.random() < buy:
                    at.append(float(k))
            return at, True
        rate = g.gamma(q["r"], 1 / q["alpha"])
        if model == "pareto":
            end = g.exponential(1 / g.gamma(q["s"], 1 / q["beta"]))
            now = g.exponential(1 / rate)
            while now <= min(t, end):
                at.append(now)
                now += g.exponential(1 / rate)
            return at, end > t
        chance = g.beta(q["a"], q["b"])
        if model == "mbg" and g.random() < chance:
            return at, False
        now = g.exponential(1 / rate)
        while now <= t:
            at.append(now)
            if g.random() < chance:
                return at, False
            now += g.exponential(1 / rate)
        return at, True

    def run(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                at, alive = one(i)
                rows += [(int(i), x) for x in [0.0, *at]] if log else [(int(i), len(at), at[-1] if at else 0.0, t, alive)]
            yield pd.DataFrame(rows, columns=["customer", "at"] if log else ["customer", "frequency", "recency", "t", "alive"])

    return spark.range(customers).mapInPandas(run, "customer long, at double" if log else "customer long, frequency long, recency double, t double, alive boolean")
