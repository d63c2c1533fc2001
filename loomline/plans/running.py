"""Queries on pipelines, policies, batches and single-file exports, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import running as P
from ..operators import chunking as C
from ..operators import search as R
from ..session import spread
from ..sources import exports as X
from .evaluation import t
from .reading import folder, nations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


class _Scale:
    """Divides by the largest value that was seen in fitting."""

    def fit(self, df):
        top = df.agg(F.max("c_acctbal").alias("top"))
        return lambda x: x.join(F.broadcast(top)).withColumn("scaled", F.round(F.col("c_acctbal") / F.col("top"), 6)).drop("top")


class _Fewer:
    def resample(self, df):
        return df.where("c_acctbal < 5000")


def _pipeline(s, d):
    p = P.ResamplingPipeline([("fewer", _Fewer()), ("scale", _Scale())])
    c = t(s, d, "customer").select("c_custkey", "c_acctbal")
    p.fit(c)
    return p.transform(c).select("c_custkey", "scaled")


query("resampling_pipeline", "select c_custkey, round(c_acctbal / (select max(c_acctbal) from customer where c_acctbal < 5000), 6) as scaled from customer")(_pipeline)


def _fussy(x: str) -> str:
    if "U" in x:
        raise ValueError(x)
    return x.lower()


query("error_policy", "select n_nationkey, case when n_name not like '%U%' then lower(n_name) end as name from nation")(lambda s, d: t(s, d, "nation").select("n_nationkey", H.custom_normalizer(P.with_policy(_fussy, "skip", 1))(F.col("n_name")).alias("name")))
query("chunk_batch", "select 'k' || n_nationkey as doc_id, i::int as chunk_index, i::int * 4 as char_start, least(i * 4 + 4, length(n_name))::int as char_end, trim(substr(n_name, (i * 4 + 1)::int, 4)) as chunk from nation, range(5) r(i) where i < greatest(1, ceil((length(n_name) - 4) / 4.0) + 1)")(
    lambda s, d: P.chunk_batch(s, [r.n_name for r in nations(s, d)], [f"k{r.n_nationkey}" for r in nations(s, d)], lambda x: C.fixed_window_chars(x, "doc_id", "text", 4))
)
query(
    "chunk_pairs",
    "select doc_id, len(c)::int as n, c[1].chunk as first, c[len(c)].char_start as last_start from (select doc_id, list({'char_start': i * 400, 'chunk': trim(substr(text, i * 400 + 1, 500))} order by i) as c from (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::int + 1))::int as i from documents where trim(text) <> '') where length(trim(substr(text, i * 400 + 1, 500))) >= 1 group by 1)",
)(
    lambda s, d: P.as_pairs(C.fixed_window_chars(spread(t(s, d, "documents").select("doc_id", "text")), "doc_id", "text", 500, 100), "doc_id").select(
        "doc_id", F.size("chunks").alias("n"), F.get("chunks", 0)["chunk"].alias("first"), F.element_at("chunks", -1)["char_start"].alias("last_start")
    )
)


def _service(s, d):
    docs = spread(t(s, d, "documents").select("doc_id", "text"))
    service = P.SearchService(lambda q, k: R.strict_search(docs, F.col("text"), q, ["doc_id"], k), concurrent=2, top=3)
    found = [*service.search("  confusion matrix ", 10), *service.search("   ")]
    return s.createDataFrame([(r["doc_id"], r["score"]) for r in found], "doc_id long, score double")


query("search_service", "select doc_id, 1.0::double as score from documents where contains(lower(text), 'confusion matrix') order by doc_id limit 3")(_service)


def _single(s, d):
    p = f"{folder(s, 'single')}/t.parquet"
    X.write_single(t(s, d, "supplier").select("s_suppkey", "s_name"), p)
    return s.read.parquet(f"file://{p}")


query("write_single", "select s_suppkey, s_name from supplier")(_single)
query("vector_columns", "select vec_id as id, embedding[1] as v0, embedding[2] as v1, embedding[3] as v2 from embeddings")(lambda s, d: X.vector_columns(t(s, d, "embeddings"), "vec_id", "embedding", 3))
