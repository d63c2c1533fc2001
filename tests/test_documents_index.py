"""Readers, exports, postings, vector items, evaluation by group and purchase models: edge cases."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import hooks, strings
from loomline.operators import grouped, index, lexical, ordered, purchase
from loomline.operators import search as R
from loomline.session import materialise, scratch
from loomline.sources import documents, exports, readers


def test_readers_of_bad_files(spark):
    rows = [("a.md", bytearray(b"# x")), ("b.nope", bytearray(b"x")), ("c.xml", bytearray(b"<!DOCTYPE r><r/>")), ("d.zip", bytearray(b"no")), ("e.txt", None), ("f.txt", bytearray(b""))]
    df = spark.createDataFrame(rows, "input_path string, content binary")
    got = {r.input_path: r for r in documents.read_documents(df).collect()}
    assert got["a.md"].text == "# x" and got["a.md"].reader == "markdown" and got["f.txt"].text == ""
    assert all(got[p].error for p in ("b.nope", "c.xml", "d.zip", "e.txt"))
    assert documents.run_batch(documents.read_documents(df)).count() == 2
    with pytest.raises(RuntimeError):
        documents.run_batch(documents.read_documents(df), stop_on_error=True)
    assert documents.read_documents(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        documents.read_with(df, "x", lambda b, p: "", max_bytes=0)


def test_extractor_results():
    assert documents.normalise_chunks("a") == [{"source_type": "unknown", "section_type": "text", "text": "a"}]
    assert [c["section_type"] for c in documents.normalise_chunks(["a", {"text": "b", "section_type": "code"}])] == ["text", "code"]
    for bad in (3, {"no": 1}, [{"text": None}]):
        with pytest.raises(TypeError):
            documents.normalise_chunks(bad)


def test_tei_options():
    play = b"<TEI><text><body><div type='act'><div type='scene'><sp><speaker>A</speaker><l>x</l></sp><stage>s</stage></div><div type='scene'><p>y</p></div></div></body></text></TEI>"
    got = documents.tei(play)
    assert [(c["section_type"], c["text"], c.get("act"), c.get("scene")) for c in got] == [("verse", "A: x", 1, 1), ("stage_direction", "s", 1, 1), ("text", "y", 1, 2)]
    assert [c["text"] for c in documents.tei(play, stage_directions=False, speakers=False)] == ["x", "y"]
    assert documents.tei(b"<TEI><text><body/></text></TEI>") == []


def test_archives_keep_their_budget(spark):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as z:
        for name, text in (("a.txt", b"one"), ("/etc/x.txt", b"bad"), ("b.txt", b"x" * 100)):
            i = tarfile.TarInfo(name)
            i.size = len(text)
            z.addfile(i, io.BytesIO(text))
        z.addfile(tarfile.TarInfo("dir"), None)
    df = spark.createDataFrame([("t.tgz", bytearray(b.getvalue())), ("bad.tar", bytearray(b"zzz"))], "input_path string, content binary")
    got = {r.member: r.error for r in documents.archive_members(df, [".txt"], max_bytes=50).collect()}
    assert got["a.txt"] is None and got["/etc/x.txt"] == "unsafe path" and got["b.txt"] == "over budget" and got[None]


def test_publish_keeps_the_old_one(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    exports.publish(spark.range(3), p)
    with pytest.raises(Exception, match="boom|udf|Error"):
        exports.publish(spark.range(3).select(F.raise_error(F.lit("boom")).alias("id")), p)
    assert spark.read.parquet(p).count() == 3
    exports.publish(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5


def test_named_sets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n,\n")
    assert readers.load_dataset(spark, "a", f"file://{tmp_path}").count() == 1
    with pytest.raises(ValueError, match="known"):
        readers.load_dataset(spark, "b", f"file://{tmp_path}")


def test_postings_agree_with_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "red red blue", "Red"), (2, "blue", None), (3, None, "red"), (4, "", "")], "doc_id int, text string, title string")
    p = f"file://{tmp_path}/i"
    index.build_postings(df, "doc_id", "text", p, "title")
    got = [(r.key, r.score) for r in index.search_postings(spark, p, "red blue").orderBy("rank").collect()]
    assert got == [(r.doc_id, r.score) for r in R.bm25(df, "doc_id", "text", "red blue", title="title").orderBy("rank").collect()]
    assert index.search_postings(spark, p, "").count() == 0 and index.search_postings(spark, p, "green").count() == 0


def test_items(spark):
    df = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.0, 1.0]), ("c", [float("nan"), 0.0]), ("d", None)], "k string, v array<double>")
    assert {(r.k, r.item_id) for r in index.add_items(df, "v", [F.col("k")], 7, "drop").collect()} == {("a", 7), ("b", 8)}
    with pytest.raises(ValueError):
        index.add_items(df, "v", [F.col("k")])
    ids = spark.range(4).withColumn("v", F.array(F.col("id")))
    assert index.item_vectors(ids, "id", "v", [1, 2]).count() == 2
    with pytest.raises(KeyError):
        index.item_vectors(ids, "id", "v", [1, 9])
    assert index.choose_backend("auto", 10, 10) == "exact" and index.choose_backend("auto", 10**7, 10**9) == "planes"
    with pytest.raises(ValueError):
        index.choose_backend("other", 1, 1)


def test_forest_recall(spark, sf):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 10 = 0")
    true = {(r.query_id, r.item_id) for r in R.knn_join(q, v, "vec_id", "embedding", 10).collect()}
    near = {(r.query_id, r.item_id) for r in index.forest_knn(q, v, "vec_id", "embedding", 10, trees=16, leaf=120).collect()}
    assert len(true & near) / len(true) >= 0.9
    assert index.forest_knn(q.where("false"), v.where("false"), "vec_id", "embedding", 3).count() == 0


def test_union_find(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 5)]
    got = {r.node: r.component for r in index.union_find(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    with pytest.raises(RuntimeError):
        index.union_find(spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int"), "a", "b", most_rounds=2)


def test_upsert_and_richest(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "m")], "k int, v string")
    assert {(r.k, r.v) for r in index.upsert(old, new, "k").collect()} == {(1, "a"), (None, "n"), (2, "B"), (None, "m")}
    rows = spark.createDataFrame([("c", 1, None, 0.9), ("c", 2, "x", 0.1), (None, 3, "y", 0.5)], "c string, id int, f string, s double")
    assert {(r.c, r.id, r.s) for r in index.richest(rows, ["c"], ["f"], "s", "id").where("c is not null").collect()} == {("c", 2, 0.9)}


def test_validation(spark):
    df = spark.createDataFrame([("a", [0.2, 0.8]), ("b", [0.6, 0.4]), (None, None)], "y string, p array<double>")
    assert [r.t for r in grouped.one_hot_truth(df, "y", out="t").collect()] == [False, True, None]
    assert [r.s for r in grouped.class_score(df, "p", 0).collect()] == [0.2, 0.6, None]
    for bad in (lambda: grouped.class_score(df, "p", 2), lambda: grouped.one_hot_truth(df.where("y = 'a'"), "y"), lambda: grouped.one_hot_truth(df, "y", "z"), lambda: grouped.prepare_subset(df.where("false"), "y", []), lambda: grouped.plotting_scope(df, "none")):
        with pytest.raises(ValueError):
            bad()
    assert grouped.dummy_names(["tags", "tax", "colour"]) == {"tags": "tags", "tax": "tax", "colour": "co"}


def test_group_running_totals(spark):
    rows = [(g, x, 1) for g in ("a", None, "b") for x in range(50)]
    got = ordered.running_total(spark.createDataFrame(rows, "g string, x int, one int"), [F.col("x")], {"n": "one"}, {"all": "one"}, ["g"]).collect()
    assert len(got) == 150 and all(r.n == r.x + 1 and r.all == 50 for r in got)


def test_words(spark):
    df = spark.createDataFrame([(1, "The cities and the horses"), (2, None), (3, "x\0y"), (4, "")], "doc_id int, text string")
    assert [r.s for r in df.select(F.transform(F.split("text", " "), lexical.stem_plural).alias("s")).collect()][0] == ["The", "city", "and", "the", "horse"]
    assert {r.doc_id: r.b for r in df.select("doc_id", strings.bad_text(F.col("text")).alias("b")).collect()} == {1: None, 2: "null", 3: "nul", 4: None}
    assert lexical.sentence_chunks(df, "doc_id", "text").select("doc_id").distinct().count() == 1
    assert lexical.language_name("EN-gb") == "english" and lexical.language_name("xx") == "english" and lexical.language_name(None, "german") == "german"
    assert lexical.dictionary(df.where("false"), "text").count() == 0
    rows = lexical.keep_within(spark.createDataFrame([(1, ["a b c d e", "f", "g"]), (2, [])], "k int, p array<string>"), "k", F.col("p"), 2, 3).collect()
    assert [r.chunk for r in rows] == ["a b c", "d e", "f g"]


def test_builder_checks_its_parts(spark):
    with pytest.raises(ValueError):
        hooks.CorpusBuilder(lambda: spark.range(1), other=lambda: None)
    seen = []
    hooks.CorpusBuilder(lambda: spark.range(3), sink=lambda d: seen.append(d.count()), filter=lambda: lambda x: x.where("id > 0")).build()
    assert seen == [2]


def test_written_tables_are_deleted(spark):
    import os
    import re

    with scratch(spark):
        df = materialise(spark.range(5), "t")
        at = re.sub(r"^file:(//)?", "", df.inputFiles()[0].rsplit("/", 1)[0])
        assert os.path.exists(at)
    assert not os.path.exists(at)


def test_fit_finds_the_parameters(spark):
    true = purchase.Purchases(0.8, 6.0, 0.9, 2.2)
    got = purchase.fit_purchases(purchase.generate(spark, "bg", 4000, 60.0, vars(true), seed=1), penalty=0.0)
    x = np.array([0.0, 1.0, 3.0, 8.0])
    f = lambda p: purchase.log_likelihood(p, x, np.array([0.0, 9.0, 20.0, 50.0]), np.full(4, 60.0), np.ones(4))
    assert abs(got.r - true.r) < 0.2 and abs(got.alpha - true.alpha) < 2.0 and abs(f(got) - f(true)) < 0.1
    rows = purchase.generate(spark, "bg", 4000, 60.0, vars(true), seed=2)
    mean = rows.agg(F.avg("frequency").alias("m")).first().m
    want = spark.range(1).select(purchase.expected_new(F.lit(60.0), true).alias("e")).first().e
    assert abs(mean / want - 1) < 0.1
    for model, q in {"mbg": vars(true), "pareto": {"r": 0.5, "alpha": 10.0, "s": 0.6, "beta": 11.0}, "bgbb": {"alpha": 1.2, "beta": 0.7, "gamma": 0.6, "delta": 2.8}}.items():
        r = purchase.generate(spark, model, 200, 30.0, q)
        assert r.where("recency > t or frequency < 0 or (frequency = 0 and recency > 0)").count() == 0 and r.where("frequency > 0").count() > 20
    with pytest.raises(ValueError):
        purchase.generate(spark, "none", 1, 1.0, {})
