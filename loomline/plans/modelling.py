"""Queries on folds, models, generators and further chunkers, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..operators import chunking as C
from ..operators import clv as V
from ..operators import modeling as M
from ..session import scratch_path, spread
from .evaluation import rounded, scored, t

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
    return spread(t(s, d, "documents").select("doc_id", "text", "source", "section_type"))


def index_query(s, d):
    p = scratch_path(s, "index")
    M.save_index(t(s, d, "embeddings"), p, "vec_id", "embedding")
    return M.query_index_all(t(s, d, "embeddings").where("vec_id % 100 = 0"), p, "vec_id", "embedding", 10)


query("roc_auc_by_group", "with g as (select l_linestatus, l_extendedprice / 120000.0 as s, count(*) filter (l_returnflag = 'R') as pos, count(*) filter (l_returnflag <> 'R') as neg from lineitem group by 1, 2), c as (select *, sum(pos) over (partition by l_linestatus order by s desc) as tp from g) select l_linestatus, round(sum(neg * (2 * tp - pos) / 2.0) / (sum(pos) * sum(neg)), 6) as auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from c group by 1")(lambda s, d: rounded(M.roc_auc_by_group(scored(s, d), "l_linestatus", F.col("y"), "s"), "auc"))
query("cv_roc_auc")(lambda s, d: M.roc_auc_by_group(scored(s, d).withColumn("fold", M.fold_of(["l_orderkey"], 5)), "fold", F.col("y"), "s"))
query("cv_confusion")(lambda s, d: M.confusion_by_fold(scored(s, d), M.fold_of(["l_orderkey"], 5), "l_returnflag", "l_linestatus"))
query("expected_purchases")(lambda s, d: s.range(1, 60).select(F.col("id").alias("t"), F.round(M.expected_purchases(F.col("id"), 0.24, 4.4, 0.8, 2.5), 6).alias("n")))
query("generate_bgnbd")(lambda s, d: M.generate_bgnbd(s, 500, 52.0, 0.24, 4.4, 0.8, 2.5))
query("alive_grid", "select f::bigint as frequency, r::int as recency, round(case when f = 0 then 1 else 1 / (1 + exp(ln(0.8::double) - ln(2.5 + greatest(f, 1) - 1) + (0.24 + f) * (ln(4.4 + 52) - ln(4.4 + r)))) end, 6) as value from range(11) a(f), range(53) b(r)")(lambda s, d: M.frequency_recency_grid(s, 10, 52, lambda f, r: F.round(V.probability_alive(f, r, F.lit(52.0), 0.24, 4.4, 0.8, 2.5), 6)))
query("pca_components")(lambda s, d: M.pca(t(s, d, "embeddings"), "embedding", 2)[0].select("vec_id", "components"))
query("kmeans_elbow")(lambda s, d: M.kmeans_elbow(t(s, d, "embeddings"), "embedding", [2, 5, 10]))
query("text_classifier")(lambda s, d: M.text_classifier(docs(s, d), "text", "section_type").transform(docs(s, d)).groupBy("section_type", "prediction").count())
query("impute_neighbours")(lambda s, d: M.impute_by_neighbours(t(s, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 100 != 0, F.col("label")).alias("label")), "vec_id", "embedding", "label").select("vec_id", "label"))
query("vector_index")(index_query)
query("knuth_bins")(lambda s, d: s.createDataFrame([(M.knuth_bins(t(s, d, "orders"), "o_totalprice"),)], "bins int"))
query("fold_intervals", "with x as (select l_tax * 10 as a, l_tax * 10 + l_quantity / 10 as z, l_discount as w from lineitem), b as (select a, z, w, unnest(range(8)) as bin from x), e as (select bin, w * ((floor(z) / 8 + greatest(0, least(z - floor(z), (bin + 1) / 8) - bin / 8)) - (floor(a) / 8 + greatest(0, least(a - floor(a), (bin + 1) / 8) - bin / 8))) as e from b where z > a) select bin::int as bin, round(sum(e), 4) as exposure from e group by 1")(lambda s, d: rounded(M.fold_intervals(t(s, d, "lineitem").select((F.col("l_tax") * 10).alias("a"), (F.col("l_tax") * 10 + F.col("l_quantity") / 10).alias("z"), F.col("l_discount").alias("w")), "a", "z", "w", 8), "exposure", digits=4))
query("scalar_formulas", "select l_orderkey, l_linenumber, l_partkey, round(10 * l_quantity / sqrt(10 * (l_quantity + 4 * (0.5 + 0.1)) + 4 * 2 * 2), 6) as snr, round(l_quantity / (2 * sqrt(2 * ln(2))), 6) as sigma, round(2 * 3 + 2 * l_quantity + 2 * 3 * 4 / (50.0 - 3 - 1), 6)::double as aic, round(3 * ln(50) + 2 * l_quantity, 6) as bic from lineitem")(
    lambda s, d: rounded(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.signal_to_noise(F.lit(10.0), F.col("l_quantity"), F.lit(0.5), F.lit(0.1), F.lit(2.0), F.lit(4.0)).alias("snr"), M.fwhm_to_sigma(F.col("l_quantity")).alias("sigma"), M.aic(-F.col("l_quantity"), F.lit(3.0), F.lit(50.0)).alias("aic"), M.bic(-F.col("l_quantity"), F.lit(3.0), F.lit(50.0)).alias("bic")), "snr", "sigma", "aic", "bic")
)
_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
query("word_chunks", f"with x as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2 and w not in ({_STOP}) and not regexp_matches(w, '^[0-9]+$')) as tokens from documents) select doc_id, tokens, case when len(tokens) >= 2 then list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1]) else [] end as ngrams from x")(lambda s, d: C.word_chunks(docs(s, d), "doc_id", "text", n=2))
query("pack_sentences")(lambda s, d: C.pack_parts(docs(s, d).where("trim(text) <> ''").withColumn("p", F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01")), "doc_id", F.col("p"), 400))
query("merge_similar")(lambda s, d: C.merge_similar(C.paragraphs(docs(s, d), "doc_id", "text").withColumn("v", H.hashing_embedder(32)(F.col("chunk"))), "doc_id", "chunk", "v", "chunk_index", 0.5))
query("json_round_trip", "select s_suppkey, s_name, s_acctbal from supplier")(lambda s, d: t(s, d, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("j")).select(F.from_json("j", "s_suppkey long, s_name string, s_acctbal double").alias("r")).select("r.*"))
query("url_parts", "select input_path, 'h.example' as host, '/' || input_path as path from (select distinct input_path from reader_files)")(lambda s, d: t(s, d, "reader_files").select("input_path").distinct().select("input_path", F.parse_url(F.concat(F.lit("https://h.example/"), "input_path", F.lit("?q=1")), F.lit("HOST")).alias("host"), F.parse_url(F.concat(F.lit("https://h.example/"), "input_path", F.lit("?q=1")), F.lit("PATH")).alias("path")))
query("epoch_format", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")(lambda s, d: t(s, d, "events").select("event_id", F.date_format(F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("at")))
