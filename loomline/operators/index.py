"""Stored full-text postings, vector items, and the rows that a retriever returns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.strings import finiteness
from .ordered import running_total
from .search import distance, knn_join

#: Postings of a term fall into this many parts, so that a term in every document is no single hot key.
PARTS = 32


def build_postings(df: DataFrame, key: str, text: str, path: str, title: str | None = None, title_weight: float = 2.0) -> None:
    """Writes an inverted index: postings (token, part, key, tf, dl) sorted by token, so that a query's few terms skip most row groups; terms (token, docs); and one row of totals.

    With a title, its tokens add ``title_weight`` to the term's frequency. A
    document's repeated tokens combine before anything is shuffled.
    """
    body = F.coalesce(X.tokens(F.col(text), False), F.array().cast("array<string>"))
    x = df.select(F.col(key).alias("key"), body.alias("t"), *([F.coalesce(X.tokens(F.col(title), False), F.array().cast("array<string>")).alias("h")] if title else []))
    one = lambda c, w: F.transform(c, lambda v: F.struct(v.alias("token"), F.lit(float(w)).alias("w")))
    both = F.concat(one(F.col("t"), 1.0), one(F.col("h"), title_weight)) if title else one(F.col("t"), 1.0)
    rows = x.select("key", F.size("t").alias("dl"), F.explode(both).alias("e")).groupBy("e.token", "key", "dl").agg(F.sum("e.w").alias("tf"))
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    rows.select("token", part.alias("part"), "key", "tf", "dl").repartitionByRange("token", "part").sortWithinPartitions("token", "part").write.mode("overwrite").parquet(f"{path}/postings")
    spark = df.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.count("*").alias("docs")).write.mode("overwrite").parquet(f"{path}/terms")
    x.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")


def search_postings(spark: SparkSession, path: str, query: str, top: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score, rank): BM25 over stored postings; only those of the query's terms are read. Ties by key."""
    terms = Counter(query.lower().split())
    if not terms:
        return spark.read.parquet(f"{path}/postings").select("key", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    asked = spark.createDataFrame([(w, float(n)) for w, n in terms.items()], "token string, times double")
    idf = spark.read.parquet(f"{path}/terms").where(F.col("token").isin(*terms)).join(F.broadcast(asked), "token")
    rows = spark.read.parquet(f"{path}/postings").where(F.col("token").isin(*terms)).join(F.broadcast(idf), "token").join(F.broadcast(spark.read.parquet(f"{path}/totals")))
    weight = F.col("times") * F.log((F.col("n") - F.col("docs") + 0.5) / (F.col("docs") + 0.5) + 1)
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    got = rows.groupBy("key").agg(F.round(F.sum(weight * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)), 8).alias("score")).where("score > 0")
    best = got.orderBy(F.desc("score"), "key").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row in order for each key; rows combine before the shuffle. A null key is a key."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("s")).select(*keys, "s.*")


def richest(df: DataFrame, keys: list[str], fields: list[str], score: str, tie: str) -> DataFrame:
    """For each key its best score, and the row with most fields filled as its representative; then the higher score, then the tie column decide."""
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    best = df.groupBy(*keys).agg(F.max(score).alias("_best"))
    rep = first_by(df.withColumn("_f", filled), keys, [-F.col("_f"), -F.col(score), F.col(tie)])
    return rep.join(best, keys).withColumn(score, F.col("_best")).drop("_best", "_f")


def hybrid_search(legs: list[tuple[DataFrame, float]], records: DataFrame, key: str, chunk: list[str], fields: list[str], top: int, k: int = 60, fan_out: int = 4) -> DataFrame:
    """(chunk..., key, fields..., score): weighted reciprocal ranks of the legs' first ``top * fan_out`` rows, one row for each chunk key with its richest record; ties by key."""
    parts = [d.where(F.col("rank") <= top * fan_out).select(key, (F.lit(float(w)) / (k + F.col("rank"))).alias("c")) for d, w in legs if w > 0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(key).agg(F.round(F.sum("c"), 8).alias("score"))
    rows = records.select(key, *chunk, *fields).join(fused, key)
    return richest(rows, chunk, fields, "score", key).orderBy(F.desc("score"), key).limit(top)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key the new ones lack, and the new ones; a key that is null is never replaced."""
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def add_items(df: DataFrame, vector: str, order: list[Column], start: int = 0, non_finite: str = "error") -> DataFrame:
    """The rows with ``item_id`` from ``start`` on, in order. Vectors with a NaN or an infinity raise, or are left out with ``non_finite`` set to drop; so are null vectors. Vectors of different lengths raise."""
    x = df.withColumn("_s", finiteness(F.col(vector)))
    s = x.agg(F.count_if(F.coalesce(F.col("_s") != "finite", F.lit(True))).alias("bad"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("z")).first()
    if s.bad and non_finite == "error":
        raise ValueError(f"{s.bad} vectors are null or not finite")
    x = x.where("_s = 'finite'").drop("_s").withColumn("_one", F.lit(1).cast("long"))
    sizes = x.select(F.size(vector).alias("d")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    return running_total(x, order, {"item_id": "_one"}).drop("_one").withColumn("item_id", F.col("item_id") + (start - 1))


def item_vectors(df: DataFrame, key: str, vector: str, ids: list[int] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """(key, vector) of given ids, or of a range of them. An id that isn't there raises."""
    if ids is None:
        got = df.where(F.col(key) >= start)
        return (got if stop is None else got.where(F.col(key) < stop)).select(key, vector)
    got = df.where(F.col(key).isin(*ids)).select(key, vector)
    if got.select(key).distinct().count() != len(set(ids)):
        raise KeyError("some ids are not in the table")
    return got


def sparse_entries(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, column, value): the entries of the vectors that aren't 0, as a sparse matrix has them."""
    return df.select(key, F.posexplode(vector).alias("column", "value")).where("value <> 0")


def distance_score(d: Column, metric: str) -> Column:
    """A similarity from a distance: the cosine for angular, 1 / (1 + d) for the others."""
    return 1 - d * d / 2 if metric in ("angular", "cosine") else 1 / (1 + d)


def neighbours_of(df: DataFrame, key: str, vector: str, items: Column, k: int, with_vectors: bool = False, exclude: list[int] = ()) -> DataFrame:
    """(query_id, item_id, score, rank[, vector]) of the rows that ``items`` selects, against all rows but themselves and those excluded; exact."""
    pool = df.where(~F.col(key).isin(*exclude)) if exclude else df
    got = knn_join(df.where(items), pool, key, vector, k)
    if not with_vectors:
        return got
    return got.join(df.select(F.col(key).cast("long").alias("item_id"), F.col(vector).alias("vector")), "item_id")


#: What a search runs on by name; auto takes the exact one while the work is small.
BACKENDS = ("exact", "planes")
EXACT_WORK = 10**12


def choose_backend(name: str, queries: int, items: int) -> str:
    """exact or planes; auto is exact up to a bounded number of comparisons. An unknown name raises."""
    if name == "auto":
        return "exact" if queries * items <= EXACT_WORK else "planes"
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {BACKENDS}")
    return name


def retrieve(df: DataFrame, records: DataFrame, key: str, vector: str, query: str, embed, k: int) -> DataFrame:
    """Records with the score of a text query: the query is embedded by the function that the vectors came from, its nearest vectors are found exactly, and their records joined."""
    q = df.sparkSession.createDataFrame([(query,)], "q string").select(embed(F.col("q")).alias("_q"))
    x = df.where(F.col(vector).isNotNull()).join(F.broadcast(q))
    best = x.select(key, F.round(distance(F.col(vector), F.col("_q"), "cosine"), 8).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return records.join(F.broadcast(best), key)


#: The basic colours of the web and their red, green and blue (fixed values).
COLOURS = {
    "black": (0, 0, 0), "silver": (192, 192, 192), "gray": (128, 128, 128), "white": (255, 255, 255), "maroon": (128, 0, 0), "red": (255, 0, 0),
    "purple": (128, 0, 128), "fuchsia": (255, 0, 255), "green": (0, 128, 0), "lime": (0, 255, 0), "olive": (128, 128, 0), "yellow": (255, 255, 0),
    "navy": (0, 0, 128), "blue": (0, 0, 255), "teal": (0, 128, 128), "aqua": (0, 255, 255),
}


def closest_colours(df: DataFrame, key: str, colour: str, top: int = 1, named: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """(key, name, distance, rank): the named colours nearest to a #rrggbb value by their red, green and blue; ties by name. Other values give nothing."""
    table = named or COLOURS
    code = F.lower(F.regexp_extract(F.col(colour), r"^#?([0-9A-Fa-f]{6})$", 1))
    part = lambda i: F.conv(F.substring(F.col("c"), 2 * i + 1, 2), 16, 10).cast("int")
    x = df.select(key, code.alias("c")).where("c <> ''").select(key, *[part(i).alias(n) for i, n in enumerate("rgb")])
    far = lambda v: F.sqrt(sum((F.pow(F.col(n) - w, F.lit(2)) for n, w in zip("rgb", v)), F.lit(0.0)))
    every = F.array_sort(F.array(*[F.struct(far(v).alias("distance"), F.lit(n).alias("name")) for n, v in table.items()]))
    got = x.select(key, F.posexplode(F.slice(every, 1, top)).alias("i", "e"))
    return got.select(key, F.col("e.name").alias("name"), F.round("e.distance", 6).alias("distance"), (F.col("i") + 1).alias("rank"))


def plane_forest(items: DataFrame, key: str, vector: str, trees: int = 12, leaf: int = 100, seed: int = 3) -> tuple[list, DataFrame]:
    """A forest of random-projection trees: (trees, rows (item_id, tree, leaf)). Trees are grown on a bounded sample, down to leaves that hold about ``leaf`` rows of the whole table; then every row is dropped through them.

    The sample has at most 20,000 rows, chosen by a hash of the key. A tree's
    depth follows the number of rows, so leaves stay small at any size.
    """
    x = items.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = x.count()
    most = 20_000
    cut = 1 << 20 if n <= most else max(1, (1 << 20) * most // n)
    sample = np.array([r.v for r in x.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < cut).limit(2 * most).collect()], float)
    forest = [_grow(sample, n / max(1, len(sample)), leaf, np.random.default_rng((seed, t))) for t in range(trees)] if len(sample) else []
    shared = items.sparkSession.sparkContext.broadcast(forest)

    def drop(batches):
        for pdf in batches:
            m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
            for t, tree in enumerate(shared.value):
                yield pd.DataFrame({"item_id": pdf["id"], "tree": t, "leaf": _leaves(tree, m)})

    return forest, x.mapInPandas(drop, "item_id long, tree int, leaf long")


def _grow(sample: np.ndarray, scale: float, leaf: int, rng: np.random.Generator, deepest: int = 40) -> dict[int, tuple[np.ndarray, float]]:
    """Splits by node number (children 2i, 2i + 1): the plane between two random points of the node, at the median of its rows."""
    out: dict[int, tuple[np.ndarray, float]] = {}
    todo = [(1, np.arange(len(sample)))]
    while todo:
        node, at = todo.pop()
        if len(at) * scale <= leaf or len(at) < 4 or node >> deepest:
            continue
        a, b = sample[rng.choice(at, 2, replace=False)]
        way = a - b
        if not np.any(way):
            continue
        side = sample[at] @ way
        mid = float(np.median(side))
        left, right = at[side <= mid], at[side > mid]
        if not len(left) or not len(right):
            continue
        out[node] = (way, mid)
        todo += [(2 * node, left), (2 * node + 1, right)]
    return out


def _leaves(tree: dict[int, tuple[np.ndarray, float]], m: np.ndarray) -> np.ndarray:
    node = np.ones(len(m), np.int64)
    todo = [1] if 1 in tree else []
    while todo:
        i = todo.pop()
        at = np.flatnonzero(node == i)
        way, mid = tree[i]
        node[at] = 2 * i + (m[at] @ way > mid)
        todo += [c for c in (2 * i, 2 * i + 1) if c in tree and len(at)]
    return node


def forest_knn(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, trees: int = 12, leaf: int = 100, seed: int = 3) -> DataFrame:
    """(query_id, item_id, score, rank): nearest items by cosine among those that share a leaf with the query in any tree; ties by item."""
    forest, rows = plane_forest(items, key, vector, trees, leaf, seed)
    shared = items.sparkSession.sparkContext.broadcast(forest)
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))

    def drop(batches):
        for pdf in batches:
            m = np.array(pdf["q"].tolist(), float).reshape(len(pdf), -1)
            for t, tree in enumerate(shared.value):
                yield pd.DataFrame({"query_id": pdf["query_id"], "tree": t, "leaf": _leaves(tree, m)})

    pairs = q.mapInPandas(drop, "query_id long, tree int, leaf long").join(rows, ["tree", "leaf"]).where("query_id <> item_id").select("query_id", "item_id").distinct()
    v = items.select(F.col(key).cast("long").alias("item_id"), F.col(vector).alias("v"))
    scored = pairs.join(q, "query_id").join(v, "item_id").select("query_id", "item_id", F.round(distance(F.col("q"), F.col("v"), "cosine"), 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def union_find(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each node is connected with, by hooking on the least neighbour and halving of paths until nothing changes. No convergence within ``most_rounds`` raises."""
    from ..session import materialise

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialise(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    for _ in range(most_rounds):
        # a node takes the least label among its neighbours', and then the label of its label
        near = both.join(label.toDF("v", "cv"), "v").groupBy("u").agg(F.min("cv").alias("m"))
        hooked = label.join(near, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("before"))
        jumped = hooked.alias("x").join(hooked.select(F.col("u").alias("w"), F.col("c").alias("cw")), F.col("x.c") == F.col("w"), "left")
        new = materialise(jumped.select("u", F.least("c", F.coalesce("cw", "c")).alias("c"), "before"), "labels")
        if not new.where("c <> before").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        label = new.select("u", "c")
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
