"""Round trips through sources, sinks and user-defined parts, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..session import scratch_path, spread
from ..sources import readers as R
from ..sources import sinks as S
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


def docs(s, d):
    return t(s, d, "documents").select("doc_id", "text", "source")


def round_trip(s, df, fmt, schema=None):
    p = scratch_path(s, fmt)
    S.export_documents(df, p, fmt)
    return S.load_documents(s, p, fmt, **({"schema": schema} if schema else {}))


_ALL = "select doc_id, text, source from documents"
query("roundtrip_parquet", _ALL)(lambda s, d: round_trip(s, docs(s, d), "parquet"))
query("roundtrip_orc", _ALL)(lambda s, d: round_trip(s, docs(s, d), "orc"))
query("roundtrip_jsonl", _ALL)(lambda s, d: round_trip(s, docs(s, d), "jsonl", "doc_id long, text string, source string"))
query("roundtrip_json", _ALL)(lambda s, d: R.load_data(s, _json(s, d), ".jsonl", schema="doc_id long, text string, source string"))
query("roundtrip_csv", "select p_partkey, p_name, p_brand, p_size, p_retailprice from part")(lambda s, d: round_trip(s, t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), "csv", "p_brand string, p_name string, p_partkey long, p_retailprice double, p_size int"))


def _json(s, d):
    p = scratch_path(s, "json")
    S.export_documents(docs(s, d), p, "json")
    return p


query("metadata_columns", "select c_custkey as doc_id, c_name as text, c_mktsegment as segment, cast(c_nationkey as varchar) as nation from customer")(
    lambda s, d: S.flatten_metadata(t(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("metadata")))
)


def _directory(s, d):
    p = scratch_path(s, "texts")
    t(s, d, "nation").select("n_name").repartition(3, "n_name").write.text(p)
    got = R.read_texts(R.corpus_directory(s, p, [".txt"]))
    return got.select(F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("n_name"), "encoding")


query("read_directory", "select n_name, 'utf-8' as encoding from nation")(_directory)


def _manifest(s, d):
    p = scratch_path(s, "manifest")
    rows = t(s, d, "reader_files").select("input_path").distinct()
    rows.unionByName(s.createDataFrame([("# comment",), ("",)], "input_path string")).select("input_path").write.text(p)
    return R.corpus_manifest(s, p).select(F.regexp_replace("input_path", r"^.*?/(corpora/)", "$1").alias("input_path"))


query("read_manifest", "select distinct input_path from reader_files")(_manifest)
query("custom_chunker", "select doc_id, unnest(range(0, greatest(1, ceil(length(text) / 100.0))::int))::int as chunk_index, unnest(range(0, greatest(1, ceil(length(text) / 100.0))::int) )::int * 100 as char_start from documents where text is not null and text <> ''")(
    lambda s, d: H.custom_chunks(spread(docs(s, d)), "doc_id", "text", lambda x: [(i, x[i : i + 100]) for i in range(0, len(x), 100)]).select("doc_id", "chunk_index", "char_start")
)
query("custom_filter", "select doc_id from documents where length(text) % 2 = 0")(lambda s, d: docs(s, d).where(H.custom_filter(lambda x: len(x) % 2 == 0)(F.col("text"))).select("doc_id"))
query("custom_normalizer", "select doc_id, reverse(source) as r from documents")(lambda s, d: docs(s, d).select("doc_id", H.custom_normalizer(lambda x: x[::-1])(F.col("source")).alias("r")))
query("custom_scorer", "select doc_id, length(coalesce(text, ''))::double as score from documents order by 2 desc, 1 limit 10")(lambda s, d: H.custom_scores(docs(s, d), "doc_id", "text", lambda ts: [float(len(x)) for x in ts], 10))
query("hashing_embeddings")(lambda s, d: spread(docs(s, d)).select("doc_id", H.hashing_embedder(32)(F.col("text")).alias("embedding")))
query("embedding_cache", "select count(distinct text) as n from documents where text is not null")(lambda s, d: (lambda e, x: H.embed_with_cache(s, x, "text", H.embed_with_cache(s, x.where("doc_id % 2 = 0"), "text", None, e), e).agg(F.count("*").alias("n")))(H.hashing_embedder(16), spread(docs(s, d))))
