"""Edge cases of the core operators: empty tables, nulls, ties, one class."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import chunking, encode, metrics, ordered, search, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_running_total_matches_numpy(spark):
    rows = [(i, i % 7) for i in range(500)]
    got = ordered.running_total(frame(spark, rows, "k int, v int"), [F.asc("k")], {"t": "v"}, {"g": "v"}).orderBy("k").collect()
    want = np.cumsum([v for _, v in rows])
    assert [r.t for r in got] == want.tolist() and {r.g for r in got} == {int(want[-1])}


def test_running_total_of_nothing(spark):
    assert ordered.running_total(frame(spark, [], "k int, v int"), [F.asc("k")], {"t": "v"}).count() == 0


def test_with_previous_crosses_partitions(spark):
    df = frame(spark, [(i,) for i in range(200)], "k int")
    got = ordered.with_previous(df, [F.asc("k")], {"p": ("k", -1)}).orderBy("k").collect()
    assert [r.p for r in got] == [-1, *range(199)]


def test_quantiles_leave_out_nan_and_null(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", None), ("b", None)], "g string, x double")
    assert [tuple(r) for r in ordered.quantiles(df, "x", {"m": 0.5}, ["g"]).collect()] == [("a", 1.5)]
    assert ordered.quantiles(df.where("false"), "x", {"m": 0.5}).first().m is None


def test_curves_of_one_class_and_of_nothing(spark):
    one = frame(spark, [(True, 0.5), (True, 0.7)], "y boolean, s double")
    assert metrics.roc_auc(one, F.col("y"), "s").first().auc is None
    assert {r.fpr for r in metrics.roc_curve(one, F.col("y"), "s").collect()} == {None, 0.0}
    empty = one.where("false")
    for f in (metrics.roc_curve, metrics.pr_curve, metrics.gain_curve, metrics.lift_curve, metrics.ks_curve):
        f(empty, F.col("y"), "s").collect()
    assert metrics.decile_table(empty, F.col("y"), "s", []).count() == 0
    assert metrics.average_precision(empty, F.col("y"), "s").count() == 1


def test_auc_counts_ties_as_half(spark):
    df = frame(spark, [(True, 0.5), (False, 0.5), (None, 0.9), (True, None), (True, float("nan"))], "y boolean, s double")
    assert metrics.roc_auc(df, F.col("y"), "s").first().auc == 0.5


def test_ntile_matches_sql(spark):
    for n in (1, 5, 10, 23, 100):
        df = spark.range(1, n + 1)
        df.createOrReplaceTempView("n_view")
        want = [r.t for r in spark.sql("select ntile(10) over (order by id) as t from n_view").collect()]
        assert [r.t for r in df.select(metrics.ntile_of(F.col("id"), F.lit(n), 10).alias("t")).collect()] == want


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(i, rng.normal(i % 3, 0.5, 4).tolist(), i % 3) for i in range(40)] + [(99, [9.0] * 4, 7)]
    got = {r.cluster: r.silhouette for r in metrics.silhouette(frame(spark, pts, "id int, v array<double>, c int"), "id", "v", "c").collect()}
    v, c = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    want = {}
    for i in range(len(pts)):
        own = (c == c[i]).sum()
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        a = d[i][c == c[i]].sum() / (own - 1) if own > 1 else None
        want.setdefault(int(c[i]), []).append(0.0 if a is None else (b - a) / max(a, b))
    assert all(math.isclose(got[k], float(np.mean(x)), abs_tol=1e-9) for k, x in want.items())


def test_statistics_of_nothing_and_of_constants(spark):
    same = frame(spark, [("a", 2.0)] * 5, "g string, x double")
    r = stats.biweight(same, "x", ["g"]).first()
    assert r.biweight_location == 2.0 and r.biweight_midvariance == 0.0
    assert stats.histogram(same, "x").count() == 1
    empty = same.where("false")
    assert stats.mad_std(empty, "x", ["g"]).count() == 0
    assert stats.histogram(empty, "x").count() == 0
    stats.sigma_clipped_stats(empty, "x").collect()


def test_chunks_of_blank_and_null_texts(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "   "), (4, "a b c")], "k int, t string")
    for f in (lambda d: chunking.fixed_window_chars(d, "k", "t", 2), lambda d: chunking.fixed_window_tokens(d, "k", "t", 2), lambda d: chunking.paragraphs(d, "k", "t"), lambda d: chunking.sentences(d, "k", "t")):
        assert {r.k for r in f(df).collect()} == {4}


def test_text_scalars(spark):
    df = frame(spark, [("Ünï ﬁ-\nne  x​", "Москва", "a@b.co")], "a string, b string, c string")
    r = df.select(X.normalize_text(F.col("a"), lower=True).alias("a"), X.script(F.col("b")).alias("b"), X.redact(F.col("c")).alias("c"), X.grapheme_count(F.lit("éx")).alias("g")).first()
    assert r.a == "ünï fine x" and r.b == "cyrillic" and r.c == "[EMAIL]" and r.g == 2


def test_encoders_on_nulls(spark):
    df = frame(spark, [(1, "a,b,"), (2, " A , b"), (3, None), (4, "zz")], "k int, tags string")
    kept, rare = encode.categories(df, "tags", min_frequency=2)
    assert kept == ["a", "b"] and rare == ["zz"]
    got = {r.k: tuple(r)[1:] for r in encode.dummies(df, "tags", kept, rare).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0), 3: (0, 0, 0), 4: (0, 0, 1)}
    assert {r.k: r.n for r in encode.impute(frame(spark, [(1, None), (2, None)], "k int, n double"), "n", "median").collect()} == {1: None, 2: None}


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 32))
    rows = [(i, (centre[i % 20] + rng.normal(scale=0.4, size=32)).tolist()) for i in range(1000)]
    df = frame(spark, rows, "id long, v array<float>")
    q = df.where("id % 100 = 0")
    exact = {(r.query_id, r.item_id) for r in search.knn_join(q, df, "id", "v", 10).collect()}
    near = {(r.query_id, r.item_id) for r in search.lsh_knn(q, df, "id", "v", 10, 32).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_bm25_without_hits_and_on_empty(spark):
    df = frame(spark, [(1, "one two"), (2, None)], "k int, t string")
    assert search.bm25(df, "k", "t", "seven").count() == 0
    assert search.bm25(df.where("false"), "k", "t", "one").count() == 0
    assert [r.k for r in search.bm25(df, "k", "t", "one one").collect()] == [1]


def test_near_names_against_brute_force(spark):
    import itertools
    import random

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(120)} | {"old widget", "small widget", "widget"}
    df = spark.createDataFrame([(x,) for x in [*names, *names, None]], "s string")
    for most in (2, 4):
        got = [tuple(r) for r in search.near_names(df, "s", most).collect()]
        want = {(a, b, far(a, b)) for a, b in itertools.combinations(sorted(names), 2) if far(a, b) <= most}
        assert len(got) == len(want) and set(got) == want


def test_natural_order(spark):
    import random
    import re

    from loomline.functions import text
    from loomline.operators import ordered

    names = [f"{a}{i}/p{k}_{i}{e}" for a in ("balodra-", "Balodra-", "c") for i in (2, 10, 19, 100) for k in ("9", "010", "10", "8" * 30) for e in ("", ".txt", "-")] + ["", "a", "a-", "a1", "a01"]
    rows = [(x,) for x in names]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "p string").withColumn("k", text.natural_key(F.col("p"))).selectExpr("*", "1L as one")
    got = {r.p: r.pos for r in ordered.running_total(df, [F.col("k"), F.col("p")], {"pos": "one"}).collect()}
    key = lambda x: ([int(t) if t.isdigit() else t.lower() for t in re.split("([0-9]+)", x)], x)
    assert got == {x: i + 1 for i, x in enumerate(sorted(names, key=key))}


def test_natural_sort_numbers_every_path(spark, sf):
    from loomline.plans import registry

    paths = spark.read.parquet(f"{sf}/reader_files.parquet").select("input_path").distinct().count()
    got = [r.pos for r in registry.queries()["natural_sort_paths"](spark, sf).collect()]
    assert sorted(got) == list(range(1, paths + 1))
