"""Sources and sinks: encodings, archives, XML, budgets, errors."""

import io
import zipfile

import numpy as np
import pytest

from loomline.functions import hooks
from loomline.sources import readers, sinks


def test_decoding_cascade():
    assert readers.decode_bytes("é\r\nx".encode()) == ("é\nx", "utf-8")
    assert readers.decode_bytes("é".encode("cp1252"))[1] == "cp1252"
    assert readers.decode_bytes(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")
    assert readers.decode_bytes("é".encode("utf-16"))[0] == "é"
    assert readers.decode_bytes("é".encode(), "no-such")[0] == "é"


def test_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Größe\r\nx".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.MD").write_bytes("Größe".encode("cp1252"))
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {r.file_type: (r.text, r.encoding) for r in readers.read_texts(readers.corpus_directory(spark, str(tmp_path), [".txt", ".md"])).collect()}
    assert got == {".txt": ("Größe\nx", "utf-8"), ".md": ("Größe", "cp1252")}
    assert readers.corpus_directory(spark, str(tmp_path), max_bytes=1).count() == 1


def archive(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in members:
            z.writestr(n, t)
    return bytearray(b.getvalue())


def test_archives(spark):
    rows = [("ok.zip", archive([("a.txt", "one"), ("../up.txt", "bad"), ("b.txt", "two"), ("c.png", "no")])), ("bad.zip", bytearray(b"nothing"))]
    df = spark.createDataFrame(rows, "input_path string, content binary")
    got = readers.read_zip_members(df, [".txt"], max_files=3).collect()
    assert {(r.member, r.text) for r in got if r.error is None} == {("a.txt", "one"), ("b.txt", "two")}
    assert {r.error for r in got if r.member == "../up.txt"} == {"unsafe path"} and any(r.input_path == "bad.zip" and r.error for r in got)


def test_xml(spark):
    rows = [("a", bytearray(b"<r xmlns='u'><p>x <b>y</b></p><p/></r>")), ("b", bytearray(b"<!DOCTYPE r [<!ENTITY e 'x'>]><r/>")), ("c", bytearray(b"<r>"))]
    got = readers.read_xml_text(spark.createDataFrame(rows, "input_path string, content binary")).collect()
    assert [(r.element_index, r.text) for r in got if r.input_path == "a"] == [(0, "x y"), (1, "")]
    assert all(r.error for r in got if r.input_path in "bc")


def test_tables_by_suffix(spark, tmp_path):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    pdf.to_csv(tmp_path / "t.csv", index=False)
    pdf.to_feather(tmp_path / "t.feather")
    np.save(tmp_path / "t.npy", np.arange(6, dtype=float).reshape(3, 2))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.write(tmp_path / "t.csv", "t.csv")
    for s in ("csv", "feather", "zip"):
        assert readers.load_data_meta(spark, str(tmp_path / f"t.{s}"))["shape"] == (2, 2)
    assert readers.load_data(spark, str(tmp_path / "t.npy")).count() == 3
    with pytest.raises(ValueError, match="no loader"):
        readers.load_data(spark, "x.pkl")
    with pytest.raises(ValueError, match="already"):
        readers.register_loader(".csv", lambda *a: None)


def test_sqlite(spark, tmp_path):
    import sqlite3

    p = str(tmp_path / "t.db")
    con = sqlite3.connect(p)
    con.execute("create table t (a int, b text)")
    con.executemany("insert into t values (?, ?)", [(1, "x"), (2, "y")])
    con.commit()
    con.close()
    assert readers.sqlite_tables(p) == ["t"]
    assert [tuple(r) for r in readers.load_sqlite(spark, p, "select * from t order by a").collect()] == [(1, "x"), (2, "y")]
    assert readers.clean_sql("select '--a' -- b\n/* c */ , 1") == "select '--a'  \n  , 1"


def test_manifest_and_urls(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\n\n/a/b\nc/d\nhttps://e.example/f\n")
    got = {r.input_path for r in readers.corpus_manifest(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {"/a/b", f"{tmp_path}/c/d", "https://e.example/f"}
    with pytest.raises(ValueError, match="http"):
        readers.corpus_urls(spark, ["ftp://x"])


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("d1", 'a "q"\nb', {"z": "1"}, [1.0]), ("d2", None, None, None)], "doc_id string, text string, metadata map<string,string>, embedding array<float>")
    p = str(tmp_path / "csv")
    sinks.export_documents(df, p, "csv")
    got = sinks.load_documents(spark, p, "csv", schema="doc_id string, text string, z string").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [("d1", 'a "q"\nb', "1"), ("d2", None, None)]
    with pytest.raises(ValueError, match="digest"):
        sinks.load_documents(spark, p, "csv", sha256={"part.csv": "0"})
    assert sinks.save_vectors(df, str(tmp_path / "v"), "doc_id", "embedding") == 1
    sinks.export_documents(df.where("false"), str(tmp_path / "e"), "csv")


def test_hooks_report_errors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "k int, t string")

    def fn(t):
        if not t:
            raise RuntimeError("blank")
        return [(0, t)]

    got = {r.k: (r.chunk, r.error) for r in hooks.custom_chunks(df, "k", "t", fn).collect()}
    assert got == {1: ("ab", None), 2: (None, "RuntimeError: blank")}
    reg = hooks.Registry()
    reg.add("filter", "x", 1)
    with pytest.raises(ValueError, match="exists"):
        reg.add("filter", "x", 2)
    with pytest.raises(KeyError):
        reg.get("filter", "y")
