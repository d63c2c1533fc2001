"""Language and encoding operators: accuracy on held-out text, round trips, edge cases."""

import random

import pytest

from loomline.llm import corpus, encoding, language

EN = ["The quick reader checks every page before the report is written.", "We measured the value again and the result was the same as before.", "This table shows that the model keeps its order after the change."]
DE = ["Die schnelle Prüfung vergleicht jede Seite vor dem Schreiben des Berichts.", "Wir haben den Wert noch einmal gemessen und das Ergebnis war größer.", "Diese Tabelle zeigt, dass das Modell nach der Änderung gleich bleibt."]
FR = ["La lecture rapide vérifie chaque page avant l'écriture du rapport.", "Nous avons mesuré la valeur encore une fois et le résultat était élevé.", "Ce tableau montre que le modèle garde son ordre après la modification."]


def models(n=60, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for lang, pool in (("en", EN), ("de", DE), ("fr", FR)):
        for _ in range(n):
            texts.append(" ".join(rng.sample(pool, 2)))
            labels.append(lang if rng.random() > 0.08 else "en")  # some labels are wrong
    return language.LanguageFilter.fit(texts, labels), encoding.GarbleModel.fit(texts * 3)


@pytest.fixture(scope="module")
def fitted():
    return models()


def test_sentences_of_a_mixed_text(fitted):
    m = fitted[0]
    text = " ".join(EN[:2]) + "\n\n" + " ".join(DE[:2])
    s = m.sentences([text])
    names = [m.classes[k] if k >= 0 else None for k in s["cls"]]
    assert [n for n in names if n] == ["en", "en", "de", "de"]
    assert all(0 <= c <= 1 for c in s["conf"])


def test_long_text_without_full_stop(fitted):
    s = fitted[0].sentences(["the reader checks the page " * 9000])
    assert len(s["doc"]) >= 4 and s["conf"].max() <= 1


def test_tag_documents_edge_cases(spark, fitted):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (4, " ".join(DE), "x"), (5, " ".join(DE), "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, language_found string")
    got = {r.doc_id: r for r in language.tag_documents(df, fitted[0]).collect()}
    assert got[1].language_found is None and got[2].languages_mask == 0 and got[3].language_confidence == 0
    assert got[4].language_found == "de" and got[4].language_confidence > 0.5 and got[4].languages_mask == got[5].languages_mask > 0
    assert language.tag_documents(df.where("false"), fitted[0]).count() == 0


def test_passages_cover_the_text(spark, fitted):
    text = " ".join(EN) + "\n\n" + " ".join(FR) + "\n\n" + " ".join(DE)
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc_id string, text string")
    got = language.tag_passages(df, fitted[0]).orderBy("char_start").collect()
    assert [r.passage_language for r in got] == ["en", "fr", "de"] and {r.doc_id for r in got} == {"a"}
    assert got[0].char_start == 0 and got[-1].char_end == len(text)


RU = ["Читатель проверяет каждую страницу перед тем как написать отчёт.", "Мы снова измерили значение и результат остался таким же.", "Эта таблица показывает что модель сохраняет свой порядок."]
ZH = ["读者在写报告之前检查每一页的内容。", "我们再次测量了这个数值结果与以前相同。", "这张表格说明模型在修改之后保持顺序。"]


def test_passages_of_garbled_texts(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for lang, pool in (("en", EN), ("ru", RU), ("zh", ZH)):
        for _ in range(60):
            texts.append(" ".join(rng.sample(pool, 2)))
            labels.append(lang)
    model, garble = language.LanguageFilter.fit(texts, labels), encoding.GarbleModel.fit((texts + ZH + RU) * 3)
    wrong = lambda t, n=1: t if n == 0 else wrong(t.encode("utf-8").decode("latin-1"), n - 1)
    parts = [" ".join(EN) + "\n\n", " ".join(RU) + "\n\n", "".join(ZH) + "\n\n", " ".join(EN)]
    rows = [(n, "".join(parts[:1] + [wrong(p, n) for p in parts[1:]])) for n in range(3)]
    glued = [(3, wrong("".join(ZH) + "".join(RU)))]
    got: dict[int, list] = {}
    for r in language.tag_passages(spark.createDataFrame(rows + glued, "doc_id int, text string"), model, garble=garble).collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.passage_language, r.char_end))
    for n, text in rows:
        edges = [0]
        for k, p in enumerate(parts):
            edges.append(edges[-1] + len(wrong(p, n) if k else p))
        passages = sorted(got[n])
        assert [p[1] for p in passages] == ["en", "ru", "zh", "en"], n
        assert [text[a:z].strip("\n") for a, _, z in passages] == [text[a:z].strip("\n") for a, z in zip(edges, edges[1:])], n
    border = len(wrong("".join(ZH)))
    assert sorted(got[3]) == [(0, "zh", border), (border, "ru", len(glued[0][1]))]


def test_labels(spark):
    codes = {"en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "german": "de"}
    df = spark.createDataFrame([("EN",), ("en-GB",), ("German",), ("de_AT",), ("und",), ("",), (None,), ("xx-en",), ("english-x",)], "l string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(corpus.language_label(F.col("l"), codes)).collect()]
    assert got == ["en", "en", "de", "de", None, None, None, None, None]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_round_trip_of_utf8(fitted, wrong):
    m = fitted[1]
    for text in DE[:2] + FR:
        bad = text.encode("utf-8").decode(wrong, "replace") if wrong != "cp1252" else "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode("utf-8"))
        fixed, how = m.repair(bad)
        assert how and fixed == text, (wrong, bad, fixed)


def test_nested_layers_and_clean_text(fitted):
    m = fitted[1]
    once = DE[0].encode("utf-8").decode("latin-1")
    twice = once.encode("utf-8").decode("latin-1")
    assert m.repair(twice)[0] == DE[0]
    for text in EN + DE + FR + ["", "It costs £5 – “fine”…", "a\tb\r\nc"]:
        assert m.repair(text) == (text, None)
    assert m.repair("gr\ufffd\ufffder") == ("gr\ufffd\ufffder", "lost")


def test_repair_edge_cases(spark, fitted):
    bad = DE[0].encode("utf-8").decode("latin-1")
    df = spark.createDataFrame([(1, None, bad), (2, "", None), (3, bad * 400, "x")], "k int, text string, title string")
    got = {r.k: r for r in encoding.repair_texts(df, fitted[1], "text", "title").collect()}
    assert got[1].text_repaired is None and got[1].title_garbling and got[2].text_garbling is None
    assert got[3].text_repaired == DE[0] * 400
    flags = {r.k: r.garbled for r in encoding.garbled_flags(df, fitted[1], "text", "title").collect()}
    assert flags == {1: True, 2: False, 3: True}
    assert encoding.repair_texts(df.where("false"), fitted[1], "text").count() == 0


def test_files(spark, fitted):
    u = bytearray(DE[0].encode("utf-8"))
    rows = [("ok", u, "UTF-8"), ("cut", u[: u.index(0xC3) + 1], "utf8"), ("bad", bytearray(DE[0].encode("cp1252")), "utf-8"), ("mis", u, "cp1252"), ("none", u, None), ("null", None, "utf-8"), ("odd", u, "no-such")]
    df = spark.createDataFrame(rows, "input_path string, raw_head binary, encoding string")
    got = {r.input_path: r.garbling for r in encoding.decode_files(df, fitted[1]).collect()}
    assert set(got) == {"ok", "cut", "bad", "mis", "odd"}
    assert got["ok"] is None and got["cut"] is None and got["bad"] == got["odd"] == "undecodable" and "utf-8" in got["mis"]


def table_of_texts(spark, sf, tmp_path, n=9000):
    """A folder like the test tables, with n documents, and the texts and labels of these."""
    from pathlib import Path

    rng = random.Random(5)
    pools = [("en", EN), ("de", DE), ("French", FR), ("ru", RU), ("zh", ZH)]
    rows = []
    for i in range(n):
        lang, pool = rng.choice(pools)
        # a word that four documents have
        word = "".join(chr(97 + i // 4 // 26**k % 26) for k in range(3)) + "qx"
        rows.append((i, " ".join(rng.sample(pool, 2)) + f" {word} {chr(0x3b1 + i % 24)}{i}", lang if rng.random() > 0.05 else None, "code" if i % 50 == 0 else "text"))
    rows += [(n, None, "en", "text"), (n + 1, "", "en", None), (n + 2, "short\0text", "de", "text")]
    for p in Path(sf).glob("*.parquet"):
        if p.stem != "documents":
            (tmp_path / p.name).symlink_to(p)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, section_type string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_garbling_is_fitted_on_every_text(spark, sf, tmp_path, monkeypatch):
    rows = table_of_texts(spark, sf, tmp_path)
    used, flags = [], encoding.garbled_flags
    monkeypatch.setattr(encoding, "garbled_flags", lambda df, model, *c: (used.append(model), flags(df, model, *c))[1])
    encoding.p6_found(spark, str(tmp_path))
    assert used == [encoding.GarbleModel.fit([r[1] for r in rows if r[1] is not None])]


def test_counts_are_summed_in_the_worker(monkeypatch):
    import numpy as np

    monkeypatch.setattr(corpus, "HELD", 40)
    t, got = corpus.Tally(), {}
    rng = np.random.default_rng(3)
    every = [rng.integers(0, 90, 30) for _ in range(50)]
    for keys in every:
        t.add(keys)
        if t.full():
            for k, n in zip(*t.take()):
                got[k] = got.get(k, 0) + n
        assert t.size <= 40 + 90
    for k, n in zip(*t.take()):
        got[k] = got.get(k, 0) + n
    k, n = np.unique(np.concatenate(every), return_counts=True)
    assert got == dict(zip(k, n)) and not len(t.take()[0])


def test_what_is_usual_grows_with_the_texts():
    few, many = (encoding.GarbleModel.fit(EN * n + ["ž"] * 2) for n in (20, 20_000))
    assert "ž" in few.singles and "ž" not in many.singles


def test_languages_are_fitted_on_every_text(spark, sf, tmp_path, monkeypatch):
    import numpy as np

    rows = table_of_texts(spark, sf, tmp_path)
    used, tag = [], language.tag_documents
    monkeypatch.setattr(language, "tag_documents", lambda df, model, **k: (used.append(model), tag(df, model, **k))[1])
    language.p1_found(spark, str(tmp_path))
    names = {"French": "fr"}
    labelled = [(r[1], "code" if r[3] == "code" else names.get(r[2], r[2])) for r in rows if r[1] and len(r[1]) > 40]
    want = language.LanguageFilter.fit([t for t, x in labelled if x], [x for _, x in labelled if x])
    got = used[0]
    assert got.classes == want.classes == ["de", "en", "fr", "ru", "zh", "code"]
    assert all((a == b).all() for a, b in zip(got.first + got.second, want.first + want.second))
    assert np.allclose(got.false_rate, want.false_rate)


def test_gram_sets():
    import numpy as np

    texts = ["", *EN, "x", "a\0bc", ZH[0], "", "ends"]
    got = language.gram_sets(texts)
    assert len(got) == len(texts) and not language.gram_sets([])
    for t, h in zip(texts, got):
        assert (h == np.unique(language.grams(language._points(t))[0])).all() and h.dtype == np.uint32
