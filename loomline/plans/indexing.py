"""Queries on stored postings, vector items and retrievers' rows, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hooks as H
from ..operators import index as N
from ..operators import search as R
from ..session import scratch_path, spread
from .evaluation import t
from .retrieval import TERMS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def docs(s, d, *more):
    return spread(t(s, d, "documents").select("doc_id", "text", "source", "section_type", *more))


def vectors(s, d):
    return t(s, d, "embeddings")


def _bm25(title: bool) -> str:
    """Scores of all documents that have a term."""
    words = TERMS.split()
    tok = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+'), lambda w: lower(w))"
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}'))" + (f" + 2.0 * len(list_filter(h, lambda x: x = '{w}'))" if title else "") + f" as f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(words)))
    score = " + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    source = f"(select doc_id, {tok.format(c='text')} as w, {tok.format(c='title')} as h from (select doc_id, text, case when doc_id % 3 = 0 then 'Histogram of ' || source else source end as title from documents))"
    return f"with f as (select doc_id, len(w) as dl, {tf} from {source}), s as (select count(*) as n, avg(dl) as avgdl, {df} from f), z as (select doc_id, round(({score})::double, 8) as score from f, s where {' + '.join(f'f{i}' for i in range(len(words)))} > 0)"


def titled(s, d):
    return docs(s, d).withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Histogram of "), "source")).otherwise(F.col("source")))


_RANKED = " select {k}, score, (row_number() over (order by score desc, doc_id))::int as rank from z order by score desc, doc_id limit 10"
query("bm25_titles", _bm25(True) + _RANKED.format(k="doc_id"))(lambda s, d: R.bm25(titled(s, d), "doc_id", "text", TERMS, title="title"))


def _stored(title):
    def run(s, d):
        p = scratch_path(s, "postings")
        N.build_postings(titled(s, d), "doc_id", "text", p, "title" if title else None)
        return N.search_postings(s, p, TERMS)

    return run


query("postings_search", _bm25(False) + _RANKED.format(k="doc_id as key"))(_stored(False))
query("postings_search_titles", _bm25(True) + _RANKED.format(k="doc_id as key"))(_stored(True))


def _terms(s, d):
    p = scratch_path(s, "postings")
    N.build_postings(docs(s, d), "doc_id", "text", p)
    return s.read.parquet(f"{p}/terms")


query("postings_terms", "select token, count(distinct doc_id) as docs from (select doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) as token from documents) group by 1")(_terms)

query("first_by_chunk", "select input_path, chunk_index, doc_id from (select *, row_number() over (partition by input_path, chunk_index order by stored_at desc, doc_id) as r from (select distinct input_path, chunk_index, doc_id, stored_at from corpus_documents)) where r = 1")(
    lambda s, d: N.first_by(t(s, d, "corpus_documents").select("input_path", "chunk_index", "doc_id", "stored_at"), ["input_path", "chunk_index"], [-F.unix_micros(F.col("stored_at").cast("timestamp")), F.col("doc_id")]).select("input_path", "chunk_index", "doc_id")
)
query("repair_duplicates", "select doc_id, max(n) as kept, count(*) - 1 as dropped from (select doc_id, row_number() over (order by doc_id, stored_at, chunk_index) as n from (select doc_id, stored_at, chunk_index from corpus_documents)) group by 1 having false union all select doc_id, count(*) as kept, count(*) - 1 as dropped from corpus_documents group by 1")(
    lambda s, d: t(s, d, "corpus_documents").groupBy("doc_id").agg(F.count("*").alias("kept"), (F.count("*") - 1).alias("dropped"))
)
query("richest_record", "with f as (select source, doc_id, n_chars, (lang is not null and lang <> '')::int + (collection_id is not null and collection_id <> '')::int as f, coalesce(n_chars, 0)::double as score from documents), r as (select *, row_number() over (partition by source order by f desc, score desc, doc_id) as r, max(score) over (partition by source) as best from f) select source, doc_id, best as score from r where r = 1 and source is not null")(
    lambda s, d: N.richest(docs(s, d, "lang", "collection_id", "n_chars").withColumn("score", F.coalesce("n_chars", F.lit(0)).cast("double")), ["source"], ["lang", "collection_id"], "score", "doc_id").select("source", "doc_id", "score")
)


def _hybrid(s, d):
    one = R.bm25(docs(s, d), "doc_id", "text", TERMS, top=40)
    w = Window.orderBy(F.desc("score"), "doc_id")
    two = docs(s, d).where(F.length("text") > 0).select("doc_id", F.length("text").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(40).withColumn("rank", F.row_number().over(w))
    return N.hybrid_search([(one, 0.7), (two, 0.3)], docs(s, d, "lang", "collection_id"), "doc_id", ["source"], ["lang", "collection_id"], 10)


query(
    "hybrid_records",
    _bm25(False)
    + """, a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from z), b as (select doc_id, row_number() over (order by length(text) desc, doc_id) as rank from documents where length(text) > 0),
    l as (select doc_id, 0.7::double / (60 + rank) as c from a where rank <= 40 union all select doc_id, 0.3::double / (60 + rank) from b where rank <= 40), g as (select doc_id, round(sum(c), 8) as score from l group by 1),
    r as (select source, doc_id, lang, collection_id, score, max(score) over (partition by source) as best, row_number() over (partition by source order by (lang is not null and lang <> '')::int + (collection_id is not null and collection_id <> '')::int desc, score desc, doc_id) as r from g join documents using (doc_id) where source is not null)
    select source, doc_id, lang, collection_id, best as score from r where r = 1 order by best desc, doc_id limit 10""",
)(lambda s, d: _hybrid(s, d).where("source is not null"))
query("upsert_rows", "select doc_id, source || '!' as source from documents where doc_id % 5 = 0 union all select doc_id, source from documents where doc_id % 5 <> 0")(
    lambda s, d: N.upsert(docs(s, d).select("doc_id", "source"), docs(s, d).where("doc_id % 5 = 0").select("doc_id", F.concat("source", F.lit("!")).alias("source")), "doc_id")
)


def _jsonl_page(s, d):
    p = scratch_path(s, "store")
    docs(s, d).select("doc_id", "source", "section_type").write.option("ignoreNullFields", False).json(p)
    store = s.read.schema("doc_id long, source string, section_type string").json(p)
    return R.storage_query(store, ["doc_id"], 15, 30, section_type="text")


query("jsonl_page", "select doc_id, source, section_type from documents where section_type = 'text' order by doc_id limit 15 offset 30")(_jsonl_page)
query("add_items", "select vec_id, (row_number() over (order by label, vec_id) + 99)::bigint as item_id from embeddings")(lambda s, d: N.add_items(vectors(s, d), "embedding", [F.col("label"), F.col("vec_id")], 100).select("vec_id", "item_id"))
query("item_vectors", "select vec_id, embedding from embeddings where vec_id in (3, 5, 400)")(lambda s, d: N.item_vectors(vectors(s, d), "vec_id", "embedding", [5, 3, 400]))
query("item_range", "select vec_id, embedding from embeddings where vec_id >= 20 and vec_id < 40")(lambda s, d: N.item_vectors(vectors(s, d), "vec_id", "embedding", start=20, stop=40))
query("sparse_entries", "select vec_id, i::int as \"column\", round(v, 5) as value from (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding::double[]) as v from embeddings) where v <> 0")(
    lambda s, d: N.sparse_entries(vectors(s, d), "vec_id", "embedding").select("vec_id", "column", F.round(F.col("value").cast("double"), 5).alias("value"))
)
query("distance_score", "select o_orderkey, round(1 - (o_orderkey % 20 / 10.0::double)**2 / 2, 6) as angular, round(1 / (1 + o_orderkey % 20 / 10.0::double), 6) as other from orders")(
    lambda s, d: t(s, d, "orders").select("o_orderkey", F.round(N.distance_score(F.col("o_orderkey") % 20 / 10.0, "angular"), 6).alias("angular"), F.round(N.distance_score(F.col("o_orderkey") % 20 / 10.0, "euclidean"), 6).alias("other"))
)
_PAIR = "with p as (select a.vec_id as query_id, b.vec_id as item_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and b.vec_id not in (1, 2)), z as (select query_id, item_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 8) as score from p), k as (select *, (row_number() over (partition by query_id order by score desc, item_id))::int as rank from z)"
query("query_by_item", _PAIR + " select * from k where rank <= 5")(lambda s, d: N.neighbours_of(vectors(s, d), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5, exclude=[1, 2]))
query("query_item_vectors", _PAIR + " select query_id, item_id, rank, len(embedding)::int as dims from k join embeddings on vec_id = item_id where rank <= 3")(
    lambda s, d: N.neighbours_of(vectors(s, d), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 3, True, [1, 2]).select("query_id", "item_id", "rank", F.size("vector").alias("dims"))
)
query("forest_knn")(lambda s, d: N.forest_knn(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d), "vec_id", "embedding", 10))
query("choose_backend", "select s_suppkey, case when s_suppkey * 100000000000 <= 1000000000000 then 'exact' else 'planes' end as backend from supplier")(
    lambda s, d: s.createDataFrame([(r.s_suppkey, N.choose_backend("auto", r.s_suppkey, 10**11)) for r in t(s, d, "supplier").select("s_suppkey").toLocalIterator()], "s_suppkey long, backend string")
)
query("retrieve_records")(lambda s, d: N.retrieve(docs(s, d).withColumn("v", H.hashing_embedder(32)(F.col("text"))), docs(s, d), "doc_id", "v", "histogram of the ranking", H.hashing_embedder(32), 10))
_HEX = "'#' || printf('%06x', (o_orderkey * 7919) % 16777216)"
_RGB = "select o_orderkey, ('0x' || substr(h, 2, 2))::int as r, ('0x' || substr(h, 4, 2))::int as g, ('0x' || substr(h, 6, 2))::int as b from (select o_orderkey, " + _HEX + " as h from orders)"
_NAMED = ", ".join(f"('{n}', {r}, {g}, {b})" for n, (r, g, b) in N.COLOURS.items())
query(
    "closest_colours",
    f"with x as ({_RGB}), c(name, cr, cg, cb) as (values {_NAMED}), z as (select o_orderkey, name, round(sqrt((r - cr)**2 + (g - cg)**2 + (b - cb)**2), 6) as distance from x, c), k as (select *, (row_number() over (partition by o_orderkey order by distance, name))::int as rank from z) select * from k where rank <= 2",
)(lambda s, d: N.closest_colours(t(s, d, "orders").select("o_orderkey", F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("o_orderkey") * 7919) % 16777216), 6, "0"))).alias("h")), "o_orderkey", "h", 2))
query(
    "union_find",
    "with recursive e as (select distinct u, v from (select l_partkey as u, 1000000 + l_suppkey as v from lineitem where l_linenumber = 7 and l_quantity < 4 union all select 1000000 + l_suppkey, l_partkey from lineitem where l_linenumber = 7 and l_quantity < 4)), r(node, c) as (select u, u from e union select e.v, r.c from r join e on e.u = r.node) select node, min(c) as component from r group by 1",
)(lambda s, d: N.union_find(t(s, d, "lineitem").where("l_linenumber = 7 and l_quantity < 4").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")), "a", "b"))
