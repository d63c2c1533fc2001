"""Round trips through document readers, table formats and exports, with their checking SQL."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import documents as D
from ..sources import exports as X
from ..sources import readers as R
from .evaluation import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def folder(s, name) -> str:
    """A new folder in the shared one, as a local path."""
    p = re.sub(r"^file:(//)?", "", scratch_path(s, name))
    os.makedirs(p)
    return p


def nations(s, d) -> list:
    """A fixed table of 25 rows."""
    return t(s, d, "nation").orderBy("n_nationkey").collect()


def files(s, contents: list[tuple[str, bytes]]):
    return s.createDataFrame([(p, bytearray(b)) for p, b in contents], "input_path string, content binary")


_NATION = "select n_nationkey, n_name, n_regionkey from nation"


def _pdf(s, d) -> pd.DataFrame:
    return pd.DataFrame([(r.n_nationkey, r.n_name, r.n_regionkey) for r in nations(s, d)], columns=["n_nationkey", "n_name", "n_regionkey"]).astype({"n_nationkey": "int32", "n_regionkey": "int32"})


_KIND = "n_nationkey int, n_name string, n_regionkey int"


def _table(fmt):
    def run(s, d):
        p, x = folder(s, fmt), _pdf(s, d)
        if fmt == "feather":
            x.to_feather(f"{p}/t.feather")
        elif fmt == "zip":
            with zipfile.ZipFile(f"{p}/t.zip", "w") as z:
                z.writestr("t.csv", x.to_csv(index=False))
        elif fmt == "csv.gz":
            x.to_csv(f"{p}/t.csv.gz", index=False)
        elif fmt == "tsv.bz2":
            x.to_csv(f"{p}/t.tsv.bz2", index=False, sep="\t")
        elif fmt == "txt":
            x.to_csv(f"{p}/t.txt", index=False, sep="\t")
        elif fmt == "json":
            x.to_json(f"{p}/t.json", orient="records", indent=2)
        return R.load_data(s, f"file://{p}/t.{fmt}", schema=_KIND).select("n_nationkey", "n_name", "n_regionkey")

    return run


for _f in ("feather", "zip", "csv.gz", "tsv.bz2", "txt", "json"):
    query(f"load_{_f.replace('.', '_')}", _NATION)(_table(_f))


def _npy(s, d):
    import numpy as np

    p = folder(s, "npy")
    np.save(f"{p}/t.npy", np.array([[r.n_nationkey, r.n_regionkey] for r in nations(s, d)], float))
    return R.load_data(s, f"file://{p}/t.npy").select(F.col("row").cast("int").alias("row"), F.get("vector", 1).cast("int").alias("region"))


query("load_npy", "select n_nationkey as row, n_regionkey as region from nation")(_npy)


def _db(s, d) -> str:
    p = folder(s, "db") + "/t.sqlite"
    con = sqlite3.connect(p)
    _pdf(s, d).to_sql("nation", con, index=False)
    con.execute("create table other (x int)")
    con.commit()
    con.close()
    return p


query("load_sqlite", "select n_nationkey::bigint as n_nationkey, n_name from nation where n_regionkey = 1")(lambda s, d: R.load_sqlite(s, _db(s, d), "select n_nationkey, n_name from nation where n_regionkey = 1"))
query("read_sqlite", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")(lambda s, d: D.read_sqlite(s, _db(s, d), "nation", 4))
query("sqlite_tables", "select unnest(['nation', 'other']) as name")(lambda s, d: s.createDataFrame([(n,) for n in R.sqlite_tables(_db(s, d))], "name string"))
query("clean_sql", "select 'select ''--a'' as x from t' as q")(lambda s, d: s.createDataFrame([(" ".join(R.clean_sql("select '--a' as x -- b\n /* c */ from t").split()),)], "q string"))
query("corpus_urls", "select 'https://h.example/' || n_name as input_path from nation where n_nationkey < 5")(lambda s, d: R.corpus_urls(s, [f"https://h.example/{r.n_name}" for r in nations(s, d)[:5]]))
query("load_meta", "select 25::bigint as n_rows, 3::bigint as n_columns, '.parquet' as format")(
    lambda s, d: (lambda m: s.createDataFrame([(m["shape"][0], m["shape"][1], m["format"])], "n_rows long, n_columns long, format string"))(R.load_data_meta(s, f"{d}/nation.parquet"))
)
_PATHS = ["https://h.example/A.CSV.gz?x=1", "/d/b.tar.gz", "c.md", "noext", "s3a://k/e.parquet"]
query(
    "format_of",
    "select * from (values ('https://h.example/A.CSV.gz?x=1', true, '.csv.gz', '.csv', '.gz'), ('/d/b.tar.gz', false, '.tar.gz', '.tar', '.gz'), ('c.md', false, '.md', '.md', null), ('noext', false, '', '', null), ('s3a://k/e.parquet', true, '.parquet', '.parquet', null)) v(path, is_url, extension, suffix, compression)",
)(lambda s, d: s.createDataFrame([(p, *(D.format_of(p)[k] for k in ("is_url", "extension", "suffix", "compression"))) for p in _PATHS], "path string, is_url boolean, extension string, suffix string, compression string"))

def _workbook(s, d):
    p = folder(s, "xlsx")
    rows = nations(s, d)
    names = ["n_nationkey", "n_name", "n_regionkey", *[r.n_name for r in rows]]
    cell = lambda at, v, kind="": f'<c r="{at}"{kind}><v>{v}</v></c>'
    text = ' t="s"'
    lines = ["<row>" + "".join(cell(f"{x}1", i, text) for i, x in enumerate("ABC")) + "</row>"]
    lines += [f"<row>{cell(f'A{i + 2}', r.n_nationkey)}{cell(f'B{i + 2}', i + 3, text)}{cell(f'C{i + 2}', r.n_regionkey)}</row>" for i, r in enumerate(rows)]
    with zipfile.ZipFile(f"{p}/t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{n}</t></si>" for n in names) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(lines) + "</sheetData></worksheet>")
    return R.load_data(s, f"file://{p}/t.xlsx")


query("load_xlsx", "select n_nationkey::double as n_nationkey, n_name, n_regionkey::double as n_regionkey from nation")(_workbook)


def _named(s, d):
    p = folder(s, "sets")
    with open(f"{p}/nations.csv", "w") as f:
        f.write(_pdf(s, d).to_csv(index=False) + ",,\n")
    return R.load_dataset(s, "nations", f"file://{p}", _KIND)


query("load_dataset", _NATION)(_named)


# documents
_BODY = {".md": "# {n}\n\nAbout *{n}*.", ".rst": "{n}\n====\n\n.. note:: {n}", ".txt": "{n} plain\r\nline", ".unknown": "{n}"}


def _mixed(s, d):
    return files(s, [(f"in/{r.n_nationkey}{x}", b.format(n=r.n_name).encode()) for r in nations(s, d) for x, b in _BODY.items()])


query(
    "read_documents",
    """select 'in/' || n_nationkey || x as input_path, reader, kind as source_type, case when reader = 'none' then null else replace(replace(b, '{n}', n_name), chr(13), '') end as text, reader = 'none' as failed
    from nation, (values ('.md', 'markdown', 'markdown', '# {n}' || chr(10) || chr(10) || 'About *{n}*.'), ('.rst', 'rest', 'documentation', '{n}' || chr(10) || '====' || chr(10) || chr(10) || '.. note:: {n}'), ('.txt', 'text', 'text', '{n} plain' || chr(13) || chr(10) || 'line'), ('.unknown', 'none', 'unknown', '')) v(x, reader, kind, b)""",
)(lambda s, d: D.read_documents(_mixed(s, d)).select("input_path", "reader", "source_type", "text", F.col("error").isNotNull().alias("failed")))


def _batch(s, d):
    seen: list = []
    rows = D.run_batch(D.read_documents(_mixed(s, d)), callback=lambda p, n, e: seen.append((p, n, e is not None)))
    return s.createDataFrame(seen, "input_path string, n long, failed boolean").join(rows.groupBy("input_path").agg(F.count("*").alias("kept")), "input_path", "left").na.fill(0)


query("run_batch", "select 'in/' || n_nationkey || x as input_path, (x <> '.unknown')::bigint as n, x = '.unknown' as failed, (x <> '.unknown')::bigint as kept from nation, (select unnest(['.md', '.rst', '.txt', '.unknown']) as x)")(_batch)


def _folders(s, d):
    a, b = folder(s, "a"), folder(s, "b")
    for r in nations(s, d):
        with open(f"{a if r.n_nationkey % 2 else b}/{r.n_nationkey}.MD", "w") as f:
            f.write(r.n_name)
    return D.read_sources(s, [f"file://{a}", f"file://{b}"]).select("source_no", F.regexp_extract("input_path", r"([^/]+)$", 1).alias("name"), "reader", "text")


query("read_sources", "select 1 - n_nationkey % 2 as source_no, n_nationkey || '.MD' as name, 'markdown' as reader, n_name as text from nation")(_folders)
query("reachable", "select 1 as n where false")(lambda s, d: D.reachable(s, f"{d}/nation.parquet").select(F.lit(1).alias("n")))
query("custom_reader", "select n_nationkey || '.x' as input_path, i::int as chunk_index, case i when 0 then n_name else n_name || '!' end as text, case i when 0 then 'text' else 'caption' end as section_type, case i when 1 then '7' end as page from nation, range(2) r(i)")(
    lambda s, d: D.read_with(files(s, [(f"{r.n_nationkey}.x", r.n_name.encode()) for r in nations(s, d)]), "own", lambda b, p: [b.decode(), {"text": b.decode() + "!", "section_type": "caption", "page": 7}]).select("input_path", "chunk_index", "text", "section_type", F.try_element_at("attributes", F.lit("page")).alias("page"))
)
_PAGE = "<html><head><title>{n}</title><style>x</style></head><body><nav>menu</nav><h2>About &amp; {n}</h2><p>It is <b>{n}</b>.</p><ul><li>one</ul><script>s()</script><pre>a &lt; b</pre></body></html>"
query("web_sections", "select n_nationkey || '.html' as input_path, i::int as chunk_index, k as section_type, replace(b, '{n}', n_name) as text from nation, (values (0, 'title', '{n}'), (1, 'header', 'About & {n}'), (2, 'text', 'It is {n}.'), (3, 'list_item', 'one'), (4, 'code', 'a < b')) v(i, k, b)")(
    lambda s, d: D.read_documents(files(s, [(f"{r.n_nationkey}.html", _PAGE.format(n=r.n_name).encode()) for r in nations(s, d)])).select("input_path", "chunk_index", "section_type", "text")
)
_TEI = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><p>no</p></teiHeader><text><body><div type='act' n='2'><head>Act</head><div type='scene'><pb n='9'/><sp><speaker>{n}</speaker><l n='1'>a line</l><p>some prose</p></sp><stage>exit</stage></div></div></body></text></TEI>"
query(
    "read_tei",
    "select n_nationkey || '.xml' as input_path, i::int as chunk_index, k as section_type, replace(b, '{n}', n_name) as text, '2' as act, sc as scene, pg as page, ln as line from nation, (values (0, 'header', 'Act', null, null, null), (1, 'verse', '{n}: a line', '1', '9', '1'), (2, 'dialogue', '{n}: some prose', '1', '9', null), (3, 'stage_direction', 'exit', '1', '9', null)) v(i, k, b, sc, pg, ln)",
)(
    lambda s, d: D.read_documents(files(s, [(f"{r.n_nationkey}.xml", _TEI.format(n=r.n_name).encode()) for r in nations(s, d)])).select(
        "input_path", "chunk_index", "section_type", "text", *[F.try_element_at("attributes", F.lit(k)).alias(a) for k, a in (("act", "act"), ("scene", "scene"), ("page_number", "page"), ("line_number", "line"))]
    )
)
query("read_xml_text", "select n_nationkey || '.xml' as input_path, 0 as element_index, 'x ' || n_name as text from nation")(
    lambda s, d: R.read_xml_text(files(s, [(f"{r.n_nationkey}.xml", f"<r xmlns='u'><p>x <b>{r.n_name}</b></p></r>".encode()) for r in nations(s, d)])).select("input_path", "element_index", "text")
)
query("xml_guard", "select n_nationkey || '.xml' as input_path, true as refused from nation")(
    lambda s, d: R.read_xml_text(files(s, [(f"{r.n_nationkey}.xml", b"<!DOCTYPE r [<!ENTITY e 'x'>]><r><p>&e;</p></r>") for r in nations(s, d)])).select("input_path", F.col("error").isNotNull().alias("refused"))
)
_ALTO = "<alto xmlns='http://www.loc.gov/standards/alto/ns-v3#'><Layout><Page><PrintSpace><TextBlock HPOS='1' VPOS='2' WIDTH='3' HEIGHT='4'><TextLine><String CONTENT='{n}' WC='0.5'/><String CONTENT='p{p}' WC='90'/></TextLine><TextLine><String CONTENT='end'/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"


def _alto(s, d, granularity):
    def pack(n):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for p in (10, 2):
                z.writestr(f"page{p}.xml", _ALTO.format(n=n, p=p))
        return b.getvalue()

    rows = D.read_with(files(s, [(f"{r.n_nationkey}.zip", pack(r.n_name)) for r in nations(s, d)]), "alto", lambda b, _p: D.alto(b, granularity))
    return rows.select("input_path", "chunk_index", "text", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in ("page_number", "bbox", "confidence")])


query("read_alto", "select n_nationkey || '.zip' as input_path, i::int as chunk_index, n_name || ' p' || p || chr(10) || 'end' as text, i::varchar as page_number, '1,2,3,4' as bbox, '0.7' as confidence from nation, (values (0, 2), (1, 10)) v(i, p)")(lambda s, d: _alto(s, d, "block"))
query("read_alto_lines", "select n_nationkey || '.zip' as input_path, i::int as chunk_index, case when i % 2 = 0 then n_name || ' p' || p else 'end' end as text, (i // 2)::varchar as page_number, ',,,' as bbox, case when i % 2 = 0 then '0.7' end as confidence from nation, (values (0, 2), (1, 2), (2, 10), (3, 10)) v(i, p)")(lambda s, d: _alto(s, d, "line"))
_CUES = {
    ".srt": "1\n00:00:01,000 --> 00:00:02,500\n<i>{n}</i>\nmore\n",
    ".vtt": "WEBVTT\n\n00:01.000 --> 00:02.500\n{n} more\n",
    ".sbv": "0:00:01.000,0:00:02.500\n{n}\nmore\n",
    ".sub": "{{25}}{{62}}{n}|more\n",
    ".lrc": "[ar:x]\n[00:01.00]{n} more\n[00:02.50]end\n",
}
query(
    "read_subtitles",
    "select n_nationkey || x as input_path, 'subtitles' as reader, i::int as chunk_index, case i when 0 then n_name || ' more' else 'end' end as text, case i when 0 then '1.0' else '2.5' end as start_s, case when i = 1 then null when x = '.sub' then '2.48' else '2.5' end as end_s from nation, (values ('.srt', 0), ('.vtt', 0), ('.sbv', 0), ('.sub', 0), ('.lrc', 0), ('.lrc', 1)) v(x, i)",
)(
    lambda s, d: D.read_documents(files(s, [(f"{r.n_nationkey}{x}", b.format(n=r.n_name).encode()) for r in nations(s, d) for x, b in _CUES.items()])).select(
        "input_path", "reader", "chunk_index", "text", F.try_element_at("attributes", F.lit("start_s")).alias("start_s"), F.try_element_at("attributes", F.lit("end_s")).alias("end_s")
    )
)
query("read_jsonl", "select 'a.jsonl' as input_path, n_nationkey::int as chunk_index, n_name as text, n_regionkey::varchar as region from nation")(
    lambda s, d: D.read_documents(files(s, [("a.jsonl", "\n".join(f'{{"text": "{r.n_name}", "region": {r.n_regionkey}}}' for r in nations(s, d)).encode())])).select("input_path", "chunk_index", "text", F.try_element_at("attributes", F.lit("region")).alias("region"))
)


def _archives(s, d):
    def tar(n, mode):
        b = io.BytesIO()
        with tarfile.open(fileobj=b, mode=mode) as z:
            for name, text in ((f"{n}.txt", n), ("../out.txt", "x")):
                i = tarfile.TarInfo(name)
                i.size = len(text)
                z.addfile(i, io.BytesIO(text.encode()))
        return b.getvalue()

    packed = files(s, [(f"{r.n_nationkey}.tar.gz", tar(r.n_name, "w:gz" if r.n_nationkey % 2 else "w")) for r in nations(s, d)])
    return D.archive_members(packed).select("input_path", "member", "n_bytes", F.col("content").cast("string").alias("text"), "error")


query("archive_members", "select n_nationkey || '.tar.gz' as input_path, case i when 0 then n_name || '.txt' else '../out.txt' end as member, case i when 0 then length(n_name) else 1 end::bigint as n_bytes, case i when 0 then n_name end as text, case i when 1 then 'unsafe path' end as error from nation, range(2) r(i)")(_archives)


def _zip_texts(s, d):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for r in nations(s, d):
            z.writestr(f"{r.n_nationkey}.txt", r.n_name)
    return R.read_zip_members(files(s, [("all.zip", b.getvalue())]), [".txt"]).select("member", "text")


query("read_zip_members", "select n_nationkey || '.txt' as member, n_name as text from nation")(_zip_texts)
query("decode_files", "select n_nationkey || '.txt' as input_path, 'é ' || n_name as text, case n_nationkey % 3 when 0 then 'utf-8' when 1 then 'cp1252' else 'utf-8-sig' end as encoding from nation")(
    lambda s, d: R.read_texts(files(s, [(f"{r.n_nationkey}.txt", f"é {r.n_name}".encode(("utf-8", "cp1252", "utf-8-sig")[r.n_nationkey % 3])) for r in nations(s, d)]).withColumn("file_type", F.lit(".txt"))).select("input_path", "text", "encoding")
)

# exports
_VECS = "select vec_id as key, embedding as vector from embeddings"


def _written_npy(s, d):
    p = folder(s, "npy")
    X.write_npy(t(s, d, "embeddings"), p, "vec_id", "embedding")
    return X.read_npy(s.createDataFrame([(f"{p}/{f}",) for f in sorted(os.listdir(p)) if not f.endswith(".keys.npy")], "input_path string"))


def _written_arrow(s, d):
    p = folder(s, "arrow")
    X.write_arrow(t(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), p)
    return X.read_arrow(s.createDataFrame([(f"{p}/{f}",) for f in os.listdir(p)], "input_path string"), "p_partkey long, p_name string, p_retailprice double")


def _published(s, d):
    p = scratch_path(s, "published")
    for k in (1, 2):
        X.publish(t(s, d, "nation").withColumn("edition", F.lit(k)).select("n_nationkey", "edition"), p)
    return s.read.parquet(p)


query("write_npy", _VECS)(_written_npy)
query("write_arrow", "select p_partkey, p_name, p_retailprice from part")(_written_arrow)
query("publish", "select n_nationkey, 2 as edition from nation")(_published)
query("page_content", "select s_name as page_content, s_nationkey::varchar as nation, len(map_keys(m))::int as n from (select *, map {'a': 1, 'b': 2} as m from supplier)")(
    lambda s, d: X.page_content(t(s, d, "supplier").withColumn("gone", F.lit(None).cast("string")), "s_name", "s_nationkey", "s_suppkey", "gone").select("page_content", F.try_element_at("metadata", F.lit("s_nationkey")).alias("nation"), F.size("metadata").alias("n"))
)
query("passage_tuples", "select s_suppkey::varchar as id, s_name as text, '{\"s_nationkey\":' || s_nationkey || '}' as attributes from supplier")(lambda s, d: X.passage_tuples(t(s, d, "supplier"), "s_suppkey", "s_name", "s_nationkey").select("passage.*"))
query("tool_results", "select o_orderkey::varchar as id, case when length(o_orderpriority) > 8 then left(o_orderpriority, 7) || '…' else o_orderpriority end as content, o_totalprice as score from orders")(
    lambda s, d: X.tool_results(t(s, d, "orders"), "o_orderkey", "o_orderpriority", "o_totalprice", 8).withColumnRenamed("o_totalprice", "score")
)
query("bad_bytes", "select n_nationkey || '.md' as input_path, case when n_nationkey < 3 then 'failed' else 'read' end as state from nation")(
    lambda s, d: D.read_documents(files(s, [(f"{r.n_nationkey}.md", (r.n_name * (99 if r.n_nationkey < 3 else 1)).encode()) for r in nations(s, d)]), max_bytes=99).select("input_path", F.when(F.col("error").isNull(), "read").otherwise("failed").alias("state"))
)


def _own_suffix(s, d):
    p = folder(s, "own")
    with open(f"{p}/t.pairs", "w") as f:
        f.writelines(f"{r.n_nationkey}={r.n_name}\n" for r in nations(s, d))
    R.register_loader(".pairs", lambda spark, path, **_o: spark.read.text(path).select(F.split("value", "=")[0].cast("int").alias("n_nationkey"), F.split("value", "=")[1].alias("n_name")), override=True)
    return R.load_data(s, f"file://{p}/t.pairs")


query("registered_loader", "select n_nationkey, n_name from nation")(_own_suffix)
