"""Packing texts into boxes of fixed capacities.

Each capacity gets a packing of all documents: a document above the capacity is
cut into full boxes and a rest; no other one is cut. Lengths are integers up to
the capacity, so the collection, whatever its size, is a histogram of at most
``capacity`` counts, on which the packing is planned as patterns with
multiplicities. Documents are routed to context-size tiers (the capacity, its
half, its quarter and so on). From the longest tier on, a box opens with the
longest piece and takes the pieces of its own tier that fill it most; the gap
that stays is filled from shorter tiers in the same way. The pieces take their
places by their number among the pieces of their length.

Boxes are numbered by load, the fullest first and among these the ones with most
attention work (sum of squared lengths), and dealt out over step groups to and
fro, so that groups are equal in boxes, tokens and work.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .corpus import rank_within, table, texts_of
from .tokens import count_tokens

#: Boxes of a step group, at least; a group has one box more than another at most.
STEP_BOXES = 128


def tiers(capacity: int, least: int = 16) -> list[int]:
    """Context sizes of a capacity, the longest first."""
    out = [capacity]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out


def fullest(free: np.ndarray, space: int, low: int, top: int) -> Counter:
    """Pieces longer than ``low`` and at most ``top`` of the histogram ``free`` with the largest sum up to ``space``.

    Sums are the bits of one integer, long pieces come first, and the search ends when the space is filled.
    """
    full = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for n in (np.flatnonzero(free[low + 1 : min(top, space) + 1])[::-1] + low + 1).tolist():
        k, rest = 1, min(int(free[n]), space // n)
        while rest > 0:
            k = min(k, rest)
            now = reach | reach << (k * n) & full
            if now != reach:
                steps.append((n, k, reach))
                reach = now
            rest -= k
            k *= 2
        if reach >> space & 1:
            break
    used: Counter[int] = Counter()
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] += k
            at -= k * n
    return used


def plan(counts: np.ndarray, capacity: int, bounds: list[int] | None = None) -> list[tuple[int, dict[int, int]]]:
    """(number of boxes, pieces by length) patterns that use up the histogram ``counts`` (index: length), the greatest load first.

    ``bounds`` are the context sizes, the longest first.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, dict[int, int]]] = []
    bounds = bounds or tiers(capacity)
    for k, top in enumerate(bounds):
        low = bounds[k + 1] if k + 1 < len(bounds) else 0
        for opener in range(top, low, -1):
            while left[opener] > 0:
                left[opener] -= 1
                space = capacity - opener
                used = fullest(left, space, low, opener)
                space -= sum(n * u for n, u in used.items())
                if space and low:
                    used += fullest(left, space, 0, low)
                used[opener] += 1
                left[opener] += 1
                boxes = min(int(left[n]) // u for n, u in used.items())
                for n, u in used.items():
                    left[n] -= boxes * u
                out.append((boxes, dict(used)))
    load = lambda p: (sum(n * u for n, u in p[1].items()), sum(n * n * u for n, u in p[1].items()))
    return sorted(out, key=load, reverse=True)


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first box, pieces a box), by rank."""
    base, used = 0, Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for boxes, pieces in patterns:
        for n, u in pieces.items():
            rows.setdefault(n, []).append((used[n], base, u))
            used[n] += boxes * u
        base += boxes
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(lengths: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(box_id, box_no, step_group, key, piece_no, token_start, token_count) for every capacity.

    ``lengths`` has a unique key and sizes. A document of size 0 or null takes no
    room: it comes out once for each capacity with box_no and step_group null.
    """
    kind = lengths.schema[key].dataType.simpleString()
    boxes = F.array(*[F.struct(F.lit(b).alias("box_id"), F.lit(c).alias("capacity")) for b, c in sorted(capacities.items())])
    each = lengths.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).select(key, "n", F.explode(boxes).alias("box")).select(key, "n", "box.*")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("capacity"))))
    pieces = each.select("box_id", key, F.col("capacity"), "n", F.explode(cut).alias("piece_no"))
    pieces = pieces.select("box_id", key, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("token_start"), F.least(F.col("n") - F.col("piece_no") * F.col("capacity"), F.col("capacity")).cast("long").alias("token_count"))
    pieces = materialise(pieces, "pieces")
    # at most as many rows as the capacities add up to
    seen = pieces.groupBy("box_id", "token_count").count().collect()
    found, groups = {}, {}
    for b, c in capacities.items():
        counts = np.zeros(c + 1, np.int64)
        for r in seen:
            if r.box_id == b:
                counts[r.token_count] = r["count"]
        patterns = plan(counts, c)
        found[b] = slots(patterns)
        groups[b] = max(1, sum(n for n, _ in patterns) // STEP_BOXES)
    total = sum(r["count"] for r in seen)
    ranked = rank_within(pieces.where("token_count > 0"), ["box_id", "token_count"], [key, "piece_no"], total)
    shared = lengths.sparkSession.sparkContext.broadcast((found, groups))

    def place(batches):
        table_of, n_groups = shared.value
        for b in batches:
            d = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids, size_, rank = d["box_id"].to_pylist(), d["token_count"].to_numpy(), d["rank"].to_numpy()
            box, group = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            kinds = {}
            for i, (x, n) in enumerate(zip(ids, size_.tolist())):
                kinds.setdefault((x, n), []).append(i)
            for (x, n), at in kinds.items():
                t = table_of[x][n]
                r = rank[at]
                k = np.searchsorted(t[:, 0], r, side="right") - 1
                box[at] = t[k, 1] + (r - t[k, 0]) // t[k, 2]
                turn, seat = np.divmod(box[at], n_groups[x])
                group[at] = np.where(turn % 2 == 0, seat, n_groups[x] - 1 - seat)
            yield pa.RecordBatch.from_arrays([d["box_id"], pa.array(box), pa.array(group), d[key], d["piece_no"], d["token_start"], d["token_count"]], names=["box_id", "box_no", "step_group", key, "piece_no", "token_start", "token_count"])

    cols = ["box_id", key, "piece_no", "token_start", "token_count", "rank"]
    placed = ranked.select(*cols).mapInArrow(place, f"box_id string, box_no long, step_group long, `{key}` {kind}, piece_no int, token_start long, token_count long")
    none = F.lit(None).cast("long")
    empty = pieces.where("token_count <= 0").select("box_id", none.alias("box_no"), none.alias("step_group"), key, "piece_no", "token_start", "token_count")
    return placed.unionByName(empty)


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """box_capacities is a fixed table."""
    rows = table(spark, sf_dir, "box_capacities").where("box_id is not null and capacity_tokens > 0").collect()
    return {r.box_id: r.capacity_tokens for r in rows}


def p7_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document, or of its pieces, in boxes of each capacity."""
    docs = texts_of(spark, sf_dir)
    return pack(count_tokens(docs), _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes used of each capacity, tokens in them, the fewest boxes that could hold them, and how far the largest step group is above the mean in tokens and in work."""
    got = materialise(p7_boxes(spark, sf_dir).where("box_no is not null"), "boxes")
    caps = table(spark, sf_dir, "box_capacities")
    one = got.groupBy("box_id").agg((F.max("box_no") + 1).alias("n_boxes"), F.sum("token_count").alias("n_tokens"), F.count("*").alias("n_pieces"))
    work = F.sum(F.col("token_count") * F.col("token_count"))
    each = got.groupBy("box_id", "step_group").agg(F.sum("token_count").alias("t"), work.alias("w"))
    steps = each.groupBy("box_id").agg((F.max("t") / F.avg("t")).alias("step_unevenness"), (F.max("w") / F.avg("w")).alias("work_unevenness"))
    return one.join(F.broadcast(caps), "box_id").join(steps, "box_id").select("box_id", "n_boxes", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_boxes"), "n_tokens", "n_pieces", "step_unevenness", "work_unevenness")


QUERIES = {"p7_boxes": p7_boxes, "p7_fill": p7_fill}
