"""Queries on document rows and further text and curve operators, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import metrics as M
from .evaluation import CLASSES, TIES, multiclass, rounded, scored, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


query("promote_keys", "select c_custkey, c_name as title, c_nationkey as page, map {'seg': c_mktsegment} as metadata from customer")(
    lambda s, d: D.promote_keys(t(s, d, "customer").select("c_custkey", F.create_map(F.lit("title"), F.col("c_name"), F.lit("page"), F.col("c_nationkey").cast("string"), F.lit("seg"), F.col("c_mktsegment")).alias("raw")), "raw", {"title": "string", "page": "int"}).select("c_custkey", "title", "page", F.map_values("metadata").alias("metadata"))
)
ORACLE["promote_keys"] = "select c_custkey, c_name as title, c_nationkey as page, [c_mktsegment] as metadata from customer"
query("validate_rows", "select doc_id, stored_at, list_filter([case when not (char_end >= char_start) then 'order' end, case when not (chunk_index >= 0) then 'index' end, case when collection_id is null then 'collection' end], lambda x: x is not null) as broken from corpus_documents where len(broken) > 0")(
    lambda s, d: D.violations(t(s, d, "corpus_documents").select("doc_id", "stored_at", "char_start", "char_end", "chunk_index", "collection_id"), {"order": F.col("char_end") >= F.col("char_start"), "index": F.col("chunk_index") >= 0, "collection": F.col("collection_id").isNotNull()}).select("doc_id", "stored_at", "broken")
)
query("citations", "select (row_number() over (order by doc_id desc))::int as number, case when length(text) > 80 then substring(text, 1, 79) || '…' else text end as passage from documents order by doc_id desc limit 5")(lambda s, d: D.citations(t(s, d, "documents").select("doc_id", "text"), [F.desc("doc_id")], "text", 5, 80))
query("choose_first", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, ts, event_id) as r from events) where r = 1")(
    lambda s, d: D.choose_first(t(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2), F.col("ts"), F.col("event_id")]).select("user_id", "event_id")
)
query("run_stages", "select doc_id, lower(trim(source)) as source from documents where source is not null")(lambda s, d: D.run_stages(t(s, d, "documents").select("doc_id", "source"), [("drop", lambda x: x.where("source is not null")), ("tidy", lambda x: D.replace_fields(x, source=F.lower(F.trim("source"))))]))
query("counts_per_million", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1e6 * l_quantity / sum(l_quantity) over (partition by l_orderkey), 4) as cpm from lineitem")(lambda s, d: rounded(D.counts_per_million(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", "l_quantity").drop("l_quantity"), "cpm", digits=4))
query("sentences_of_scripts", "select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟।።])\\s+', '\\1' || chr(1), 'g'), '([。！？])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as sentences from documents where text is not null")(lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", X.split_sentences(F.col("text")).alias("sentences")))
query("script_tests", r"select doc_id, regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]') as cjk, regexp_matches(text, '[\p{Arabic}\p{Hebrew}]') as rtl, regexp_extract_all(text, '\p{Han}|[A-Za-z0-9]+') as tokens from documents")(lambda s, d: t(s, d, "documents").select("doc_id", X.has_cjk(F.col("text")).alias("cjk"), X.has_rtl(F.col("text")).alias("rtl"), X.split_cjk(F.col("text")).alias("tokens")))
query("microdvd_parse", "select n_nationkey as id, 1 as cue, 1.0::double as start_s, 3.0::double as end_s, n_name || ' x' as cue_text from nation union all select n_nationkey, 2, 4.0, 5.0, 'end' from nation")(lambda s, d: C.parse_microdvd(t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("{25}{75}"), F.col("n_name"), F.lit("|x\n{100}{125}end\nnone")).alias("x")), "id", "x"))
_M = "with m as (select *, floor(l_quantity) / 50.0 as s_a, l_extendedprice / 120000.0 as s_n, 1.0 - l_quantity / 60.0 as s_r from lineitem), x as (select 'A' as class, l_returnflag = 'A' as y, s_a as s from m union all select 'N', l_returnflag = 'N', s_n from m union all select 'R', l_returnflag = 'R', s_r from m), g as (select class, s, count(*) filter (y) as pos, count(*) filter (not y) as neg from x group by 1, 2), p as (select class, sum(neg) over w / sum(neg) over v as x, sum(pos) over w / sum(pos) over v as y from g window w as (partition by class order by s desc), v as (partition by class)), u as (select class, x, max(y) as y from (select * from p union all select distinct class, 0.0::double, 0.0::double from p) group by 1, 2), z as (select *, lag(x) over (partition by class order by x) as x0, lag(y) over (partition by class order by x) as y0 from u), k as (select i / 100.0::double as fpr from range(101) r(i))"
query("roc_macro", _M + " select fpr, round(avg(case when x0 is null or fpr = x then y else y0 + (y - y0) * (fpr - x0) / (x - x0) end), 6) as tpr from k join z on fpr <= x and (x0 is null or fpr > x0) group by 1")(lambda s, d: rounded(M.roc_macro(multiclass(s, d), "l_returnflag", CLASSES), "tpr"))
query("selection_summary")(lambda s, d: M.selection_summary(M.decile_table(scored(s, d), F.col("y"), "s", TIES), 3))
query("pairwise_differences", "select a.s_suppkey as i, b.s_suppkey as j, round(abs(a.s_acctbal - b.s_acctbal), 4) as d from supplier a join supplier b on a.s_suppkey < b.s_suppkey and a.s_nationkey = b.s_nationkey")(lambda s, d: (lambda x: x.alias("a").join(x.alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("i"), F.col("b.s_suppkey").alias("j"), F.round(F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")), 4).alias("d")))(t(s, d, "supplier")))
