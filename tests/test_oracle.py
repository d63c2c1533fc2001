"""Every query with checking SQL agrees with it."""

import pytest

from harness import compare, connect


def _names():
    from loomline.plans import registry

    return sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", _names())
def test_against_sql(spark, sf, con, name):
    assert compare(spark, name, sf, con) == ""


def _free():
    from loomline.plans import registry

    return sorted(set(registry.queries()) - set(registry.oracle_sql()))


def _within(c, low, high):
    return lambda rows: all(low <= r[c] <= high for r in rows)


def _ordered(low, high):
    return lambda rows: all(r[low] <= r[high] for r in rows)


def _ranks(rows):
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"]))
    return all([x for x, _ in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda z: (z[1], z[0])) for v in by.values())


def _covers(rows):
    by = {}
    for r in rows:
        by.setdefault(r["event_type"], []).append((r["start"], r["end"]))
    return all(all(a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) for v in by.values())


#: What must hold of the rows of queries without SQL.
HOLDS = {
    "binomial_jeffreys": _ordered("low", "high"),
    "binomial_flat": _ordered("low", "high"),
    "poisson_frequentist": lambda rows: all(r["low"] < r["n"] < r["high"] for r in rows),
    "poisson_background": lambda rows: all(0 <= r["low"] < r["high"] and r["low"] + 2 <= r["n"] + 1 for r in rows),
    "bayesian_blocks": _covers,
    "bayesian_blocks_ticks": _covers,
    "bayesian_blocks_measures": _covers,
    "bootstrap_mean": lambda rows: len(rows) == 50 and len({r["mean"] for r in rows}) == 50,
    "bootstrap_var": lambda rows: len(rows) == 50 and all(r["value"] > 0 for r in rows),
    "knn_lsh": _ranks,
    "vector_index": _ranks,
    "forest_knn": _ranks,
    "probability_plot": lambda rows: [r["observed"] for r in sorted(rows)] == sorted(r["observed"] for r in rows) and all(abs(a["expected"] + b["expected"]) < 1e-6 for a, b in zip(sorted(rows, key=lambda r: r["p"]), sorted(rows, key=lambda r: -r["p"]))),
    "learning_curve": lambda rows: all(0 <= r["test_mean"] <= 1 and r["n_train"] > 0 for r in rows),
    "fit_purchases": lambda rows: len(rows) == 1 and all(v > 0 for v in rows[0]),
    "expectation_grid": _within("expected", 0, 3),
    "customer_value_model": lambda rows: all(r["clv"] >= 0 for r in rows),
    "predicted_by_model": lambda rows: [r["predicted"] for r in sorted(rows, key=lambda r: r["period"])] == sorted(r["predicted"] for r in rows),
    "retrieve_records": lambda rows: len(rows) == 10 and all(-1 <= r["score"] <= 1 for r in rows),
    "stop_word_lists": lambda rows: all(r["n"] > 50 for r in rows),
    "keep_within": lambda rows: all(0 < len(r["chunk"].split()) <= 24 for r in rows),
    "sentence_offsets": lambda rows: all(r["char_end"] - r["char_start"] == len(r["chunk"]) for r in rows),
    "kmeans_elbow": lambda rows: [r["inertia"] for r in sorted(rows, key=lambda r: -r["k"])] == sorted(r["inertia"] for r in rows),
    "pca_components": lambda rows: all(len(r["components"]) == 2 for r in rows),
    "hashing_embeddings": lambda rows: all(len(r["embedding"]) == 32 and sum(v * v for v in r["embedding"]) < 1.001 for r in rows),
    "normalize_text": lambda rows: all(r["clean"] is None or len(r["clean"]) >= 10 and r["clean"] == r["clean"].strip() for r in rows),
    "merge_similar": lambda rows: all(r["chunk"] for r in rows),
    "text_classifier": lambda rows: sum(r["count"] for r in rows) > 0,
    "cv_roc_auc": _within("auc", 0, 1),
    "cv_confusion": _within("share", 0, 1),
}
for _k in ("bg", "mbg", "pareto", "bgbb", "bgnbd"):
    HOLDS[f"generate_{_k}"] = lambda rows: len(rows) == 500 and all(0 <= r["recency"] <= r["t"] for r in rows)
HOLDS["generate_log"] = lambda rows: len({r["customer"] for r in rows}) == 300 and all(0 <= r["at"] <= 52 for r in rows)


def test_every_free_query_is_checked():
    assert set(_free()) <= set(HOLDS)


@pytest.mark.parametrize("name", _free())
def test_runs(spark, sf, name):
    from loomline.plans import registry

    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert HOLDS[name](rows)
