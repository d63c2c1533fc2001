"""Bayesian blocks: the piecewise-constant model of a series that its likelihood supports.

A group's cells (time bins, ticks or measurements) are cut into blocks so that
the sum of the blocks' fitness, less a price for each block, is largest. With
``best[j]`` the best sum of the first j cells,

    best[j] = max over i < j of best[i] + fitness(i, j) - price,

and as no block is fitter than its two parts, a start i with
``best[i] + fitness(i, j) < best[j]`` can never win again and is dropped. So the
work follows the blocks' lengths rather than the square of the cells. Fitness of
any stretch comes from running sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fitness = Callable[[np.ndarray, int], np.ndarray]


def block_price(n: float, p0: float = 0.05, gamma: float | None = None) -> float:
    """The price of a block among n cells or events: from a prior on the number of blocks (``gamma``), or calibrated to a rate of false alarms (fixed values of the method's publication)."""
    if gamma is not None:
        return -math.log(gamma)
    return 4 - math.log(73.53 * p0 * n**-0.478)


def best_partition(cells: int, fitness: Fitness, price: float) -> list[int]:
    """Borders (from 0 to ``cells``) of the blocks with the largest total."""
    best, came = np.zeros(cells + 1), np.zeros(cells + 1, np.int64)
    starts = np.zeros(0, np.int64)
    for j in range(1, cells + 1):
        starts = np.append(starts, j - 1)
        sums = best[starts] + fitness(starts, j)
        k = int(sums.argmax())
        best[j], came[j] = sums[k] - price, starts[k]
        starts = starts[sums >= best[j]]
    borders = [cells]
    while borders[-1]:
        borders.append(int(came[borders[-1]]))
    return borders[::-1]


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(x)))


def event_fitness(counts: np.ndarray, edges: np.ndarray) -> Fitness:
    """Events in cells with the given edges: n log(n / length)."""
    total = _sums(counts)

    def f(i: np.ndarray, j: int) -> np.ndarray:
        n, length = total[j] - total[i], edges[j] - edges[i]
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-300) / length), 0.0)

    return f


def tick_fitness(hits: np.ndarray) -> Fitness:
    """Ticks that each have an event or none: the binary likelihood of the share of hits."""
    total = _sums(hits)

    def f(i: np.ndarray, j: int) -> np.ndarray:
        m = (j - i).astype(float)
        p = np.clip((total[j] - total[i]) / m, 0.0, 1.0)
        entropy = np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0.0) + np.where(p < 1, (1 - p) * np.log(np.maximum(1 - p, 1e-300)), 0.0)
        return m * entropy

    return f


def measure_fitness(x: np.ndarray, sigma: np.ndarray) -> Fitness:
    """Measurements with normal errors: half the squared weighted sum over the sum of weights."""
    w = 1 / np.square(sigma)
    weight, weighted = _sums(w), _sums(w * x)
    return lambda i, j: np.square(weighted[j] - weighted[i]) / (2 * (weight[j] - weight[i]))


def _edges(t: np.ndarray) -> np.ndarray:
    """Borders halfway between neighbouring times, and the first and last time."""
    return np.concatenate((t[:1], (t[1:] + t[:-1]) / 2, t[-1:]))


def bayesian_blocks(df: DataFrame, by: str, at: str, value: str, kind: str = "events", sigma: str | None = None, p0: float = 0.05, gamma: float | None = None) -> DataFrame:
    """(by, block, start, end, n, mean): the blocks of each group.

    ``kind`` is events (``value`` counts the events of the unit cell that starts at
    ``at``), ticks (0 or 1 at each regular tick) or measures (values with errors
    ``sigma``). A group's cells, not its events, meet in one task. Rows with a null
    time or value are left out.
    """
    kind_of = df.schema[by].dataType.simpleString()
    if kind not in ("events", "ticks", "measures"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        t, x = pdf[at].to_numpy(float), pdf[value].to_numpy(float)
        m = len(t)
        if kind == "measures":
            edges = _edges(t)
            fitness = measure_fitness(x, pdf[sigma].to_numpy(float) if sigma else np.ones(m))
        else:
            step = float(np.min(np.diff(t))) if m > 1 else 1.0
            edges = np.append(_edges(t)[:-1], t[-1] + step / 2)
            fitness = tick_fitness(np.minimum(x, 1)) if kind == "ticks" else event_fitness(x, edges)
        b = best_partition(m, fitness, block_price(max(1, m), p0, gamma))
        a, z = np.array(b[:-1]), np.array(b[1:])
        total = _sums(x)
        n = total[z] - total[a] if kind != "measures" else (z - a).astype(float)
        mean = (total[z] - total[a]) / (z - a)
        return pd.DataFrame({by: [key[0]] * len(a), "block": range(len(a)), "start": edges[a], "end": edges[z], "n": n, "mean": mean})

    fine = df.where(F.col(at).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return fine.groupBy(by).applyInPandas(run, f"`{by}` {kind_of}, block int, start double, end double, n double, mean double")
