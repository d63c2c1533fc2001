"""Mixing sources to target shares by subset-sum budget fitting.

Shares are relative weights within a mix. Its total is the largest for which
every source that exists can give its share within its allowed repeats; sources
without documents are reported with nothing. A source gives whole passes over
its documents and one partial pass. The partial pass is fitted to the token: the
documents are counted by exact token length, each length gives its proportional
number, the budget that is left is filled by bounded-knapsack dynamic programming
over the remaining counts, and seeded documents are then drawn by length.

Every length is counted, however long the document. The counts come to the
driver; distinct lengths add up to no more than the tokens of their source, so a
source of T tokens has at most sqrt(2 T) of them.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .corpus import rank_within, table
from .tokens import count_tokens

#: Tokens of budget that dynamic programming fills, or twice the longest length if that is more.
EXACT = 1 << 16
#: Rows of the plan up to which it is broadcast.
SMALL_PLAN = 100_000
SALTS = 32


def in_proportion(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Numbers by length that follow ``counts`` in proportion and stay within ``budget``.

    Lengths are taken from the longest down, and what rounding leaves of one is
    carried to the next, so that no range of lengths is favoured.
    """
    share = budget / max(1, sum(n * c for n, c in counts.items()))
    took: dict[int, int] = {}
    aim, given = 0.0, 0
    for n in sorted(counts, reverse=True):
        aim += share * n * counts[n]
        took[n] = max(0, min(counts[n], int((min(aim, budget) - given) // n)))
        given += took[n] * n
    return took


def largest_sum(items: list[tuple[int, int]], limit: int) -> dict[int, int]:
    """Numbers by length, within the (length, number) items, whose lengths add up to the largest sum up to ``limit`` that there is.

    Sums are the bits of one integer; for every sum the step that reached it
    first is kept, and steps are followed back from the largest one.
    """
    full = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    first = np.zeros(limit + 1, np.int32)
    for n, free in items:
        k = 1
        while free > 0 and not reach >> limit & 1:
            k = min(k, free)
            if k * n > limit:
                break
            fresh = reach << (k * n) & full & ~reach
            if fresh:
                raw = np.frombuffer(fresh.to_bytes(limit // 8 + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = len(steps)
                steps.append((n, k))
                reach |= fresh
            free -= k
            k *= 2
    out: dict[int, int] = {}
    at = reach.bit_length() - 1
    while at > 0:
        n, k = steps[first[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


def fill_exactly(counts: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """Numbers of items by length, within ``counts``, whose lengths add up to ``budget`` or to the largest sum below it that the last ``EXACT`` tokens allow.

    A budget within that window is always met as closely as the lengths allow.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    if budget >= sum(n * c for n, c in counts.items()):
        return counts
    if budget <= 0:
        return {}
    window = min(budget, max(EXACT, 2 * max(counts)))
    took = in_proportion(counts, budget - window)
    left = budget - sum(n * c for n, c in took.items())
    order = sorted(n for n in counts if n <= left and counts[n] > took[n])
    random.Random(seed).shuffle(order)
    for n, k in largest_sum([(n, min(counts[n] - took[n], left // n)) for n in order], left).items():
        took[n] += k
    return {n: c for n, c in took.items() if c}


@dataclass
class Part:
    """What one source gives to one mix."""

    mix_id: str
    source: str
    share: float
    max_repeats: int
    quota: int
    passes: int
    partial: int


def quotas(targets: list[tuple[str, str, float, int]], sizes: dict[str, int]) -> list[Part]:
    """Parts of all mixes from (mix_id, source, weight, max_repeats) and the tokens of each source. Rows with a null or negative weight or no allowed repeat weigh nothing."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        own = [(s, max(0.0, w or 0.0), max(0, r or 0)) for m, s, w, r in targets if m == mix]
        whole = sum(w for _, w, _ in own) or 1.0
        live = [(s, w, r) for s, w, r in own if w > 0 and r > 0 and sizes.get(s, 0) > 0]
        weight = sum(w for _, w, _ in live)
        total = min((r * sizes[s] * weight / w for s, w, r in live), default=0.0)
        for s, w, r in own:
            size = sizes.get(s, 0)
            quota = min(r * size, round(total * w / weight)) if (s, w, r) in live else 0
            passes = quota // size if size else 0
            out.append(Part(mix, s, w / whole, r, quota, passes, quota - passes * size))
    return out


def mix(docs: DataFrame, targets: list[tuple[str, str, float, int]], seed: int = 0) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, repeats) of the documents that each mix takes, ``repeats`` times each.

    ``docs`` has doc_id, source (already tidied) and n_tokens. Documents without tokens or source are never taken.
    """
    docs = docs.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens")
    docs = materialise(docs.where(F.col("source").isin(sorted({t[1] for t in targets}))), "mixable")
    counted = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toArrow().to_pydict()
    by_length: dict[str, dict[int, int]] = {}
    for s, n, c in zip(counted["source"], counted["n_tokens"], counted["n"]):
        by_length.setdefault(s, {})[n] = c
    sizes = {s: sum(n * c for n, c in own.items()) for s, own in by_length.items()}
    takes = []
    for p in quotas(targets, sizes):
        if p.quota:
            own = by_length[p.source]
            got = fill_exactly(own, p.partial, seed)
            takes += [(p.mix_id, p.source, n, p.passes, got.get(n, 0)) for n in own if p.passes or got.get(n)]
    names = "mix_id string, source string, n_tokens long, passes long, take long"
    take = docs.sparkSession.createDataFrame(takes, names)
    ranked = rank_within(docs, ["source", "n_tokens"], ["doc_id"], sum(counted["n"]))
    if len(takes) <= SMALL_PLAN:
        got = ranked.join(F.broadcast(take), ["source", "n_tokens"])
    else:
        # a length may hold a third of all rows: its rows are dealt out over salts
        salted = take.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        got = ranked.join(salted, ["source", "n_tokens", "salt"])
    repeats = F.col("passes") + (F.col("rank") < F.col("take")).cast("long")
    return got.select("mix_id", "doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, float, int]]:
    """mix_targets is a fixed table; rows without a mix or source aim at nothing."""
    rows = table(spark, sf_dir, "mix_targets").where("mix_id is not null and source is not null").collect()
    return [(r.mix_id, r.source.strip().lower(), r.target_share, r.max_repeats) for r in rows]


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text"))
    targets = _targets(spark, sf_dir)
    wanted = sorted({t[1] for t in targets})
    return mix(count_tokens(docs.where(F.col("source").isin(wanted))), targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target: the share asked for, among all and among the sources that exist, and the share, tokens and repeats reached."""
    tokens = F.sum(F.col("n_tokens") * F.col("repeats"))
    got = p8_selection(spark, sf_dir).groupBy("mix_id", "source").agg(tokens.alias("n_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("repeats"))
    t = table(spark, sf_dir, "mix_targets").select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    full = F.broadcast(t).join(got, ["mix_id", "source"], "left").na.fill(0, ["n_tokens", "n_docs", "repeats"])
    w = Window.partitionBy("mix_id")
    live = F.when(F.col("n_tokens") > 0, F.col("target_share"))
    return full.select(
        "mix_id",
        "source",
        (F.col("target_share") / F.sum("target_share").over(w)).alias("target_share"),
        (live / F.sum(live).over(w)).alias("target_among_present"),
        (F.col("n_tokens") / F.greatest(F.sum("n_tokens").over(w), F.lit(1))).alias("actual_share"),
        "n_tokens",
        "n_docs",
        "repeats",
        "max_repeats",
    )


def p8_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target whether its source has texts, how many, and its share among the sources of the mix that have."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    n = docs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n_available"))
    t = table(spark, sf_dir, "mix_targets").select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share")
    full = F.broadcast(t).join(n, "source", "left").na.fill(0, ["n_available"])
    live = F.when(F.col("n_available") > 0, F.col("target_share"))
    share = live / F.sum(live).over(Window.partitionBy("mix_id"))
    return full.select("mix_id", "source", "n_available", F.round(share, 9).alias("share_among_present"))


ORACLE = {
    "p8_present": """
        with n as (select lower(trim(source)) as source, count(*) as n_available from documents where length(text) > 0 group by 1),
        t as (select mix_id, lower(trim(m.source)) as source, target_share, coalesce(n_available, 0) as n_available
              from mix_targets m left join n on n.source = lower(trim(m.source)))
        select mix_id, source, n_available, round(case when n_available > 0 then target_share end
               / sum(case when n_available > 0 then target_share end) over (partition by mix_id), 9) as share_among_present from t""",
}
QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares, "p8_present": p8_present}
