"""Modelling operators: recall, expectations against simulation, folds and chunk folds."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomline.functions import hooks
from loomline.operators import chunking, clv, modeling, search


def test_index_recall(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    modeling.save_index(v, str(tmp_path / "i"), "vec_id", "embedding")
    q = v.where("vec_id % 100 = 0")
    exact: dict[int, set] = {}
    for r in search.knn_join(q, v, "vec_id", "embedding", 10, exclude_self=False).collect():
        exact.setdefault(r.query_id, set()).add(r.item_id)
    hit = sum(len(exact[r.vec_id] & {x.id for x in modeling.query_index(spark, str(tmp_path / "i"), list(r.embedding), 10).collect()}) for r in q.collect())
    assert hit / sum(map(len, exact.values())) >= 0.9


def test_index_answers_every_query(spark, sf, tmp_path):
    from loomline.plans import registry

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").collect()
    got: dict[int, list] = {}
    for r in registry.queries()["vector_index"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score))
    assert set(got) == {r.vec_id for r in q} and len(got) > 1
    modeling.save_index(v, str(tmp_path / "i"), "vec_id", "embedding")
    for r in q:
        one = modeling.query_index(spark, str(tmp_path / "i"), list(r.embedding), 10).collect()
        assert got[r.vec_id] == [(i + 1, x.id, x.score) for i, x in enumerate(one)]


def test_expectation_matches_simulation(spark):
    r, alpha, a, b = 0.8, 4.0, 1.8, 2.5
    want = modeling.generate_bgnbd(spark, 20000, 30.0, r, alpha, a, b, 1).agg(F.avg("frequency")).first()[0]
    got = spark.range(1).select(modeling.expected_purchases(F.lit(30.0), r, alpha, a, b)).first()[0]
    assert math.isclose(got, want, rel_tol=0.06)
    again = modeling.generate_bgnbd(spark, 100, 30.0, r, alpha, a, b, 1).repartition(7)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in modeling.generate_bgnbd(spark, 100, 30.0, r, alpha, a, b, 1).collect()}


def test_alive_is_a_probability(spark):
    g = modeling.frequency_recency_grid(spark, 5, 10, lambda f, x: clv.probability_alive(f, x, F.lit(10.0), 0.24, 4.4, 0.8, 2.5)).collect()
    assert all(0 <= r.value <= 1 for r in g) and len(g) == 66


def test_folds_are_even_and_stable(spark):
    df = spark.range(10000).withColumn("f", modeling.fold_of(["id"], 5))
    n = [r["count"] for r in df.groupBy("f").count().collect()]
    assert len(n) == 5 and min(n) > 1800
    assert modeling.roc_auc_by_group(df.withColumn("y", F.lit(True)).withColumn("s", F.rand(1)), "f", F.col("y"), "s").first().auc is None


def test_knuth_and_intervals(spark):
    x = spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).normal(size=2000)], "x double")
    assert 5 <= modeling.knuth_bins(x, "x") <= 60
    assert modeling.knuth_bins(x.where("false"), "x") == 1
    iv = spark.createDataFrame([(0.25, 2.75, 2.0), (1.0, 1.0, 5.0), (None, 1.0, 1.0)], "a double, z double, w double")
    got = {r.bin: r.exposure for r in modeling.fold_intervals(iv, "a", "z", "w", 4).collect()}
    assert math.isclose(sum(got.values()), 5.0) and math.isclose(got[1], 1.5)


def test_knuth_measures_every_number_of_bins(spark, monkeypatch):
    def best(x, most):
        n, lg = len(x), np.vectorize(math.lgamma)
        score = lambda m: n * math.log(m) + math.lgamma(m / 2) - m * math.lgamma(0.5) - math.lgamma(n + m / 2) + float(lg(np.histogram(x, np.linspace(x.min(), x.max(), m + 1))[0] + 0.5).sum())
        return max(range(1, most + 1), key=lambda m: (score(m), -m))

    monkeypatch.setattr(modeling, "CELLS", 20_000, raising=False)
    rng = np.random.default_rng(1)
    for x, over in ((rng.normal(size=3000), 0), (np.concatenate([rng.normal(0, 1, 3000), rng.normal(400, 1, 3000)]), 200)):
        want = best(x, 1500)
        assert want > over and modeling.knuth_bins(spark.createDataFrame([(float(v),) for v in x], "x double"), "x") == want


def test_pack_and_merge(spark):
    df = spark.createDataFrame([(1, ["aa", "bb", "cccccccc", "d"]), (2, [])], "k int, p array<string>")
    got = [(r.chunk_index, r.chunk) for r in chunking.pack_parts(df, "k", F.col("p"), 5).collect()]
    assert got == [(0, "aa bb"), (1, "cccccccc"), (2, "d")]
    parts = spark.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [1.0, 0.1]), (1, 2, "c", [0.0, 1.0])], "k int, i int, c string, v array<double>")
    assert [r.chunk for r in chunking.merge_similar(parts, "k", "c", "v", "i", 0.8).orderBy("chunk_index").collect()] == ["a b", "c"]


def test_impute_and_cache(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 4.0), (1, [1.0, 0.1], None), (2, [0.0, 1.0], 9.0), (3, None, None)], "id long, v array<double>, x double")
    assert {r.id: r.x for r in modeling.impute_by_neighbours(df, "id", "v", "x", 1).collect()} == {0: 4.0, 1: 4.0, 2: 9.0, 3: None}
    e = hooks.hashing_embedder(8)
    t = spark.createDataFrame([("a b",), ("a b",), (None,), ("",)], "t string")
    first = hooks.embed_with_cache(spark, t, "t", None, e)
    assert first.count() == 2 and hooks.embed_with_cache(spark, t, "t", first, e).count() == 2
