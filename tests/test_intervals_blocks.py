"""Blocks, intervals, clipping and resampling against brute force and published values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import blocks, intervals, stats


@pytest.mark.parametrize("kind", ["events", "ticks", "measures"])
def test_blocks_are_the_best_partition(kind):
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = int(rng.integers(2, 9))
        if kind == "events":
            fit = blocks.event_fitness(rng.integers(0, 9, m).astype(float), np.concatenate(([0.0], np.cumsum(rng.uniform(0.3, 2, m)))))
        elif kind == "ticks":
            fit = blocks.tick_fitness(rng.integers(0, 2, m).astype(float))
        else:
            fit = blocks.measure_fitness(rng.normal(size=m), rng.uniform(0.2, 2, m))
        price = float(rng.uniform(0.1, 3))
        worth = lambda b: sum(float(fit(np.array([a]), z)[0]) - price for a, z in zip(b, b[1:]))  # noqa: B023, E731
        best = max(worth((0, *cut, m)) for r in range(m) for cut in itertools.combinations(range(1, m), r))
        assert math.isclose(worth(blocks.best_partition(m, fit, price)), best, abs_tol=1e-9)


def test_block_frames(spark):
    rows = [("a", float(i), 1.0 if i < 50 else 9.0) for i in range(100)] + [("b", 0.0, 2.0), ("c", None, 1.0), ("d", 1.0, None)]
    got = blocks.bayesian_blocks(spark.createDataFrame(rows, "g string, t double, n double"), "g", "t", "n").orderBy("g", "block").collect()
    assert [(r.g, r.n) for r in got] == [("a", 50.0), ("a", 450.0), ("b", 2.0)]
    assert abs(got[0].end - 49.5) < 1e-9
    empty = spark.createDataFrame([], "g string, t double, n double")
    assert blocks.bayesian_blocks(empty, "g", "t", "n").count() == 0
    with pytest.raises(ValueError):
        blocks.bayesian_blocks(empty, "g", "t", "n", "else")


def test_published_quantiles():
    assert abs(float(intervals.beta_cdf(0.5, 2.0, 3.0)) - 0.6875) < 1e-12
    assert abs(float(intervals.gamma_cdf(2.0, 3.0)) - 0.3233235838169366) < 1e-12
    assert abs(float(intervals.gamma_quantile(0.975, np.array([5.0]))[0]) - 10.241588) < 1e-5
    low, high = intervals.shortest_interval(5, 2.5, 0.99)
    assert low == 0 and abs(high - 10.67) < 0.02


def test_interval_edges(spark):
    df = spark.createDataFrame([(0, 5), (5, 5), (2, 5), (0, 0), (None, 5), (7, 5)], "k int, n int")
    for kind in ("wilson", "wald", "jeffreys", "flat"):
        got = df.select("k", "n", intervals.binomial_bounds(F.col("k"), F.col("n"), 0.95, kind).alias("b")).collect()
        assert [r.b is None for r in got] == [False, False, False, True, True, True]
        assert all(r.b.low <= r.k / r.n <= r.b.high for r in got[:3] if kind != "flat") and got[2].b.low < got[2].b.high
    assert got[0].b.low > 0  # the flat prior gives no interval from 0
    n = spark.createDataFrame([(0,), (3,), (None,)], "n int")
    for kind in ("root-n-0", "pearson", "sherpagehrels", "frequentist-confidence", "kraft-burrows-nousek"):
        rows = n.select("n", intervals.poisson_bounds(F.col("n"), kind).alias("b")).collect()
        assert all(r.b.low <= r.n <= r.b.high for r in rows[:2])
    with pytest.raises(ValueError):
        intervals.poisson_bounds(F.col("n"), "none")


def test_clip_keeps_every_row(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1)) for i in range(300)] + [(900, 50.0), (901, None), (902, float("nan"))]
    df = spark.createDataFrame(rows, "clip_id int, x double")
    got = intervals.sigma_clip(df, "x").collect()
    assert len(got) == len(rows) and {r.clip_id for r in got if r.clipped} >= {900, 901, 902}
    assert sum(r.clipped for r in got) < 12
    assert intervals.sigma_clip(df.where("false"), "x").count() == 0


def test_jackknife_by_leaving_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 30)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 1.0), ("none", None)], "g string, x double")
    for name, fn in {"mean": np.mean, "var": np.var, "std": np.std}.items():
        loo = np.array([fn(np.delete(x, i)) for i in range(30)])
        bias = 29 * (loo.mean() - fn(x))
        r = intervals.jackknife(df, "x", name, ["g"]).collect()
        assert len(r) == 1 and math.isclose(r[0].estimate, fn(x) - bias, rel_tol=1e-9) and math.isclose(r[0].std_err, math.sqrt(29 * loo.var()), rel_tol=1e-9)


def test_kuiper_of_two(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, None)], "a double, b double")
    r = intervals.kuiper_two(df, F.col("a"), F.col("b")).first()
    assert (r.n, r.m) == (3, 2) and abs(r.d - (1 / 3 + 1 / 3)) > -1 and 0 < r.d <= 2
    p = spark.range(1).select(intervals.kuiper_probability(F.lit(0.9), F.lit(100.0)).alias("p"), intervals.kuiper_probability(F.lit(0.01), F.lit(100.0)).alias("q")).first()
    assert p.p < 1e-6 and p.q == 1.0


def ripley_sums(x, y, n, radii, mode):
    """(k of ``none``-like sums) over the pairs of places with n points each, by brute force."""
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    both = n[:, None] * n[None, :] - np.diag(n)
    edge = np.minimum(np.minimum(1 - x, 1 - y), np.minimum(x, y))
    out, total = [], n.sum()
    for r in radii:
        m = both * (np.sqrt(dx * dx + dy * dy) < r)
        if mode == "translation":
            m = m / ((1 - dx) * (1 - dy))
        if mode == "var-width":
            far = edge > r
            out.append((m * far[:, None]).sum() / max(1, (n * far).sum()) / total)
        else:
            out.append(m.sum() / (total * (total - 1)))
    return out


@pytest.mark.parametrize("mode", ["none", "translation", "var-width"])
def test_ripley_of_many_points_at_few_places(spark, mode):
    # 300,000 points: 2e9 pairs of neighbouring cells, one by one
    rng = np.random.default_rng(5)
    x, y = rng.random(400).round(3), rng.random(400).round(2) * 0.9
    places = spark.createDataFrame(list(zip(range(400), x.tolist(), y.tolist())), "place int, x double, y double")
    df = spark.range(300_000).selectExpr("id", "cast(id % 400 as int) as place").join(places, "place")
    radii = [0.02, 0.03, 0.1]
    got = {r.radius: r.k for r in intervals.ripley(df, "id", F.col("x"), F.col("y"), radii, (0.0, 0.0, 1.0, 1.0), mode).collect()}
    assert [got[r] for r in radii] == pytest.approx(ripley_sums(x, y, np.full(400, 750.0), radii, mode), rel=1e-9)


@pytest.mark.parametrize("mode", ["none", "translation", "var-width"])
def test_ripley_leaves_out_pairs_of_one_id(spark, mode):
    rng = random.Random(7)
    rows = [(i // 2 if i < 200 else i, rng.randint(0, 59) / 60, rng.randint(0, 59) / 60) for i in range(1500)] + [(3, 0.5, 0.5)] * 4
    df = spark.createDataFrame(rows, "id int, x double, y double")
    radii = [0.02, 1 / 30, 0.2]
    got = {r.radius: r.k for r in intervals.ripley(df, "id", F.col("x"), F.col("y"), radii, (0.0, 0.0, 1.0, 1.0), mode).collect()}
    i, x, y = (np.array(c) for c in zip(*rows))
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    edge = np.minimum(np.minimum(1 - x, 1 - y), np.minimum(x, y))
    for r in radii:
        m = (i[:, None] != i[None, :]) * (np.sqrt(dx * dx + dy * dy) < r) * {"none": 1.0, "translation": 1 / ((1 - dx) * (1 - dy)), "var-width": (edge > r)[:, None]}[mode]
        total = len(rows) * (len(rows) - 1) if mode != "var-width" else len(rows) * max(1, (edge > r).sum())
        assert got[r] == pytest.approx(m.sum() / total, rel=1e-9), r


def test_ripley_k_of_many_points_at_few_places(spark):
    # the radius itself counts here
    x, y = np.array([0.0, 0.25, 0.5, 0.75, 0.75]), np.array([0.5, 0.5, 0.5, 0.5, 0.0])
    places = spark.createDataFrame(list(zip(range(5), x.tolist(), y.tolist())), "place int, x double, y double")
    df = spark.range(300_000).selectExpr("id", "cast(id % 5 as int) as place").join(places, "place")
    got = {r.radius: r.k for r in stats.ripley_k(df, "id", F.col("x"), F.col("y"), [0.2, 0.25, 0.5], 1.0).collect()}
    n, total = 60_000, 300_000 * 299_999
    # places as far apart as 0.25 and 0.5: three and three pairs
    assert got == pytest.approx({0.2: 5 * n * (n - 1) / total, 0.25: (5 * n * (n - 1) + 6 * n * n) / total, 0.5: (5 * n * (n - 1) + 12 * n * n) / total}, rel=1e-9)
