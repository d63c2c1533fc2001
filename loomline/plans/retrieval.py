"""Queries on search and vectors, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as R
from ..session import spread
from .evaluation import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TERMS = "histogram ranking cluster"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def docs(s, d):
    return spread(t(s, d, "documents").select("doc_id", "text", "source", "section_type", "lang"))


def vectors(s, d):
    return t(s, d, "embeddings")


_TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda w: lower(w))"


def _bm25(terms: str) -> str:
    words = terms.split()
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) as f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(words)))
    score = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    return f"with x as (select doc_id, {_TOK} as w from documents), f as (select doc_id, len(w) as dl, {tf} from x), s as (select count(*) as n, avg(dl) as avgdl, {df} from f), z as (select doc_id, round(({score})::double, 8) as score from f, s where {' + '.join(f'f{i}' for i in range(len(words)))} > 0), bm as (select doc_id, score, (row_number() over (order by score desc, doc_id))::int as rank from z order by score desc, doc_id limit"


query("bm25_top10", _bm25(TERMS) + " 10) select * from bm")(lambda s, d: R.bm25(docs(s, d), "doc_id", "text", TERMS))
query("strict_search", "select doc_id, 1.0::double as score from documents where contains(lower(text), 'confusion matrix') order by doc_id limit 20")(lambda s, d: R.strict_search(docs(s, d), F.col("text"), "Confusion Matrix", ["doc_id"], 20).select("doc_id", "score"))
query("storage_query_page", "select doc_id, source from documents where section_type = 'text' and source = 'docs' order by doc_id limit 10 offset 5")(lambda s, d: R.storage_query(docs(s, d), ["doc_id"], 10, 5, section_type="text", source="docs", lang="").select("doc_id", "source"))
query("storage_query_count", "select count(*) as total, count(*) > 15 as has_more from documents where section_type = 'text' and source = 'docs'")(lambda s, d: docs(s, d).where("section_type = 'text' and source = 'docs'").agg(F.count("*").alias("total"), (F.count("*") > 15).alias("has_more")))
query("point_lookup", "select doc_id, text from documents where doc_id = 7")(lambda s, d: docs(s, d).where("doc_id = 7").select("doc_id", "text"))
_UNIT = "with q as (select embedding::double[] as q from embeddings where vec_id = 0), z as (select vec_id, round(greatest(-1, least(1, list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q, q)))), 8) as score from embeddings, q)"


def _first(s, d) -> list[float]:
    """One vector, by its key."""
    return list(vectors(s, d).where("vec_id = 0").select("embedding").first()[0])


query("cosine_topk", _UNIT + " select vec_id, score from z order by score desc, vec_id limit 10")(lambda s, d: R.cosine_to(vectors(s, d), "vec_id", "embedding", _first(s, d), 10))
query("cosine_topk_threshold", _UNIT + ", k as (select vec_id, score from z order by score desc, vec_id limit 50) select * from k where score >= 0.2")(lambda s, d: R.cosine_to(vectors(s, d), "vec_id", "embedding", _first(s, d), 50, 0.2))
_PAIR = "with p as (select a.vec_id as query_id, b.vec_id as item_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)"
query("knn_join", _PAIR + ", z as (select query_id, item_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 8) as score from p) select query_id, item_id, score, (row_number() over (partition by query_id order by score desc, item_id))::int as rank from z qualify rank <= 10")(lambda s, d: R.knn_join(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d), "vec_id", "embedding", 10))
query("knn_graph", _PAIR + ", z as (select query_id, item_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 8) as score from p), k as (select *, row_number() over (partition by query_id order by score desc, item_id) as r from z qualify r <= 5) select query_id as src, item_id as dst, round(1 - score, 8) as weight from k")(lambda s, d: R.knn_join(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d), "vec_id", "embedding", 5).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.round(1 - F.col("score"), 8).alias("weight")))
query("knn_lsh")(lambda s, d: R.lsh_knn(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d), "vec_id", "embedding", 10, 64))
for _m, _sql in {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2])**2)))",
    "manhattan": "list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))",
    "dot": "list_dot_product(a, b)",
    "angular": "sqrt(2 - 2 * greatest(-1, least(1, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))))",
}.items():
    query(f"metric_{_m}", f"with v as (select vec_id, embedding::double[] as a, (select embedding::double[] from embeddings where vec_id = 1) as b from embeddings) select vec_id, round({_sql}, 5) as d from v")(
        lambda s, d, m=_m: vectors(s, d).join(F.broadcast(vectors(s, d).where("vec_id = 1").select(F.col("embedding").alias("b")))).select("vec_id", F.round(R.distance(F.col("embedding"), F.col("b"), m), 5).alias("d"))
    )
query("metric_hamming", "select o_orderkey, cast(bit_count(xor(o_orderkey, o_custkey)) as int) as d from orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", R.hamming(F.array("o_orderkey"), F.array("o_custkey")).alias("d")))
query(
    "hybrid_rrf",
    _bm25(TERMS) + " 30), q as (select embedding::double[] as q from embeddings where vec_id = 0), sem as (select vec_id as doc_id, round(list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q, q)), 8) as score from embeddings, q order by 2 desc, 1 limit 30), sr as (select doc_id, row_number() over (order by score desc, doc_id) as rank from sem), u as (select doc_id, 0.6::double / (60 + rank) as c from bm union all select doc_id, 0.4::double / (60 + rank) from sr) select doc_id, round(sum(c), 8) as score from u group by 1 order by 2 desc, 1 limit 10",
)(
    lambda s, d: R.fuse([
        (R.bm25(docs(s, d), "doc_id", "text", TERMS, top=30), 0.6),
        (R.cosine_to(vectors(s, d).withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _first(s, d), 30).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))), 0.4),
    ], "doc_id")
)
query("vector_normalise", "with v as (select vec_id, embedding::double[] as e from embeddings) select vec_id, round(sqrt(list_dot_product(e, e)), 5) as norm, round(list_max(list_transform(e, lambda x: abs(x))), 5) as max_abs, list_max(list_transform(e, lambda x: abs(x))) < 'inf'::double as finite from v")(
    lambda s, d: vectors(s, d).select("vec_id", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 5).alias("max_abs"), F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).alias("finite"))
)
query("centroids", "with x as (select label, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) select label, i::int as i, round(avg(v), 6) as v from x group by 1, 2")(lambda s, d: vectors(s, d).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v")))
