"""Search: exact, BM25, vectors and their fusion, and paged storage queries."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PACK = 1024


def storage_query(df: DataFrame, order: list[str], limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """A page of the rows whose columns equal the given values; an empty or None value is no condition, a limit of 0 or less gives no rows."""
    for c, v in equal.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df.orderBy(*order).offset(offset).limit(max(0, limit))


def strict_search(df: DataFrame, text: Column, needle: str, order: list[str], top: int, case: bool = False) -> DataFrame:
    """The first ``top`` rows, in order, whose text holds the needle; score 1."""
    t = text if case else F.lower(text)
    return df.where(t.contains(needle if case else needle.lower())).withColumn("score", F.lit(1.0)).orderBy(*order).limit(top)


def bm25(df: DataFrame, key: str, text: str, query: str, top: int | None = 10, k1: float = 1.5, b: float = 0.75, title: str | None = None, title_weight: float = 2.0) -> DataFrame:
    """(key, score, rank): BM25 with positive inverse document frequencies; ties by key; a repeated query term counts again.

    Term frequencies of the query's few terms are counted inside each row, so
    the corpus is never exploded: one aggregate gives frequencies and lengths.
    """
    terms = Counter(w for w in query.lower().split())
    words = list(terms)
    t = X.tokens(F.col(text), False)
    x = df.select(key, F.coalesce(t, F.array().cast("array<string>")).alias("t"), *([F.coalesce(X.tokens(F.col(title), False), F.array().cast("array<string>")).alias("h")] if title else []))

    def times(column: str, w: str) -> Column:
        return F.size(F.filter(column, lambda v: v == w))

    tf = [times("t", w) + (title_weight * times("h", w) if title else 0) for w in words]
    x = x.select(key, F.size("t").alias("dl"), *[e.cast("double").alias(f"f{i}") for i, e in enumerate(tf)])
    s = x.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(words))])
    y = x.where(F.greatest(*[F.col(f"f{i}") for i in range(len(words))], F.lit(0.0)) > 0).join(F.broadcast(s))  # one row
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    idf = lambda i: F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5) + 1)
    score = sum((terms[w] * idf(i) * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + norm) for i, w in enumerate(words)), F.lit(0.0))
    got = y.select(key, F.round(score, 8).alias("score")).where("score > 0")
    if top is not None:
        got = got.orderBy(F.desc("score"), key).limit(top)
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))) if top is not None else got


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, metric: str) -> Column:
    """angular, euclidean, manhattan, dot or cosine, also by their common other names."""
    name = {"l2": "euclidean", "lstsq": "euclidean", "l1": "manhattan", "cityblock": "manhattan", "taxicab": "manhattan", "@": "dot", ".": "dot", "dotproduct": "dot", "inner": "dot", "innerproduct": "dot"}.get(metric, metric)
    if name == "dot":
        return dot(a, b)
    if name in ("cosine", "angular"):
        n = F.sqrt(dot(a, a) * dot(b, b))
        c = F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)
        return c if name == "cosine" else F.sqrt(2 - 2 * c)
    f = (lambda x, y: F.abs(x.cast("double") - y.cast("double"))) if name == "manhattan" else (lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    total = F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    return total if name == "manhattan" else F.sqrt(total)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def cosine_to(df: DataFrame, key: str, vector: str, query: list[float], top: int, threshold: float | None = None) -> DataFrame:
    """(key, score): the nearest rows to one vector; the threshold acts after the cut. A zero query gives nothing."""
    if not any(query):
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    got = df.where(F.col(vector).isNotNull()).select(key, F.round(distance(F.col(vector), q, "cosine"), 8).alias("score")).orderBy(F.desc("score"), key).limit(top)
    return got if threshold is None else got.where(F.col("score") >= threshold)


def _packs(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Blocks of up to PACK unit vectors: (ids, flat values)."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, PACK):
                part = b.slice(a, PACK)
                m = np.array([v for v in part.column(1).to_pylist()], np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.astype(np.float64).tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_m"])

    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_m binary")


def knn_join(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items of every query by cosine, exactly; ties by item.

    Queries meet items in blocks: a pair of blocks is one matrix product, which
    keeps k rows a query, and the best of all blocks are merged.
    """

    def run(batches):
        for b in batches:
            for qi, qm, ii, im in zip(*(c.to_pylist() for c in b.columns)):
                q, x = (np.frombuffer(m, np.float64).reshape(len(n), -1) for m, n in ((qm, qi), (im, ii)))
                s = np.round(np.clip(q @ x.T, -1, 1), 8)
                ids = np.array(ii)
                out: list[list] = [[], [], []]
                for r, one in enumerate(qi):
                    v = s[r].copy()
                    if exclude_self:
                        v[ids == one] = -np.inf
                    top = np.lexsort((ids, -v))[: k + 1]
                    top = top[np.isfinite(v[top])][:k]
                    out[0] += [one] * len(top)
                    out[1] += ids[top].tolist()
                    out[2] += v[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "item_id", "score"])

    blocks = _packs(queries, key, vector, "q").join(_packs(items, key, vector, "i"), how="cross")  # blocks of a stated query set
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    got = blocks.mapInArrow(run, "query_id long, item_id long, score double")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hyperplanes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, max(1, dims)))


def sign_codes(m: np.ndarray, planes: np.ndarray, tables: int, bits: int, probe: bool) -> np.ndarray:
    """Codes of vectors (rows) in every table; with ``probe`` also those one sign away."""
    sign = (m @ planes.T > 0).reshape(len(m), tables, bits)
    code = (sign << np.arange(bits)).sum(axis=2)
    base = np.arange(tables) * (1 << bits)
    keys = [base + code]
    if probe:
        keys += [base + (code ^ (1 << j)) for j in range(bits)]
    return np.concatenate(keys, axis=1)


def lsh_codes(df: DataFrame, key: str, vector: str, planes: np.ndarray, tables: int, bits: int, probe: bool, out: str) -> DataFrame:
    """(out, code): a row for each vector and code."""

    def run(batches):
        for b in batches:
            m = np.array(b.column(1).to_pylist(), np.float64)
            if len(m):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(int, r)) for r in sign_codes(m, planes, tables, bits, probe)], pa.list_(pa.int32()))], names=[out, "codes"])

    got = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, f"{out} long, codes array<int>")
    return got.select(out, F.explode("codes").alias("code"))


def code_plan(rows: int) -> tuple[int, int]:
    """(tables, bits) for so many vectors: bits grow with the logarithm of the rows, so a code holds about as many vectors at any size, and tables grow to make up for longer codes."""
    bits = min(20, max(6, math.ceil(math.log2(max(1, rows) / 64))))
    return min(256, round(24 * 2 ** ((bits - 6) / 4))), bits


def lsh_knn(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, dims: int, tables: int | None = None, bits: int | None = None, seed: int = 11) -> DataFrame:
    """(query_id, item_id, score, rank): approximate nearest items by random hyperplanes: candidates share the signs of ``bits`` projections in any table, or all but one of them. Tables and bits follow the number of items unless given."""
    if tables is None or bits is None:
        tables, bits = code_plan(items.count())
    planes = hyperplanes(dims, tables, bits, seed)
    a, b = lsh_codes(queries, key, vector, planes, tables, bits, True, "query_id"), lsh_codes(items, key, vector, planes, tables, bits, False, "item_id")
    pairs = a.join(b, "code").where("query_id <> item_id").select("query_id", "item_id").distinct()
    qv = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q"))
    iv = items.select(F.col(key).cast("long").alias("item_id"), F.col(vector).alias("v"))
    scored = pairs.join(qv, "query_id").join(iv, "item_id").select("query_id", "item_id", F.round(distance(F.col("q"), F.col("v"), "cosine"), 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(legs: list[tuple[DataFrame, float]], key: str, k: int = 60, top: int = 10) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked legs (key, rank) with weights; legs of weight 0 are skipped; ties by key."""
    parts = [d.select(key, (F.lit(float(w)) / (k + F.col("rank"))).alias("c")) for d, w in legs if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.round(F.sum("c"), 8).alias("score")).orderBy(F.desc("score"), key).limit(top)


def near_names(df: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b, distance): all pairs of distinct values, a < b, within an edit distance of ``most``.

    The shorter value of a pair is cut into ``most`` + 1 pieces; as many edits leave
    one of them whole, so it occurs in the longer value at most ``most`` places
    away. Pieces are looked up by length and number, and no pair is lost.
    """
    x = df.select(F.col(column).alias("a")).where("a is not null").distinct().withColumn("n", F.length("a"))
    edge = lambda i, n: F.floor(i * n / (most + 1)).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(most))

    def piece(text: Column, n: Column, i: Column, shift: Column) -> Column:
        start, size = edge(i, n) + shift, edge(i + 1, n) - edge(i, n)
        fits = (start >= 0) & (start + size <= F.length(text))
        return F.when(fits, F.struct(n.alias("n"), i.alias("i"), F.substring(text, start + 1, size).alias("piece")))

    short = x.select("a", F.explode(F.transform(numbers, lambda i: piece(F.col("a"), F.col("n"), i, F.lit(0)))).alias("k"))
    shifts = F.sequence(F.lit(-most), F.lit(most))
    lengths = F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n"))
    probes = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(numbers, lambda i: F.transform(shifts, lambda o: piece(F.col("a"), n, i, o))))))
    long = x.select(F.col("a").alias("b"), F.explode(F.array_distinct(F.array_compact(probes))).alias("k"))
    pairs = short.join(long, "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")
