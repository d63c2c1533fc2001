"""Queries on customer summaries, encoders, set operations and dummies, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clv as V
from ..operators import encode as E
from .evaluation import rounded, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def orders(s, d):
    return t(s, d, "orders")


def events(s, d):
    return t(s, d, "events")


O = ("o_custkey", "o_orderdate", "o_totalprice")
_P = "with p as (select o_custkey as customer, cast(date_trunc('day', o_orderdate) as date) as period, sum(o_totalprice) as money from orders{w} group by 1, 2), o as (select customer, count(*) as n, min(period) as first, max(period) as last, sum(money) as total, arg_min(money, period) as fm from p group by 1)"
_S = "select customer, n - 1 as frequency, (last - first)::double as recency, ({end} - first)::double as t, round(case when n > 1 then (total - fm) / (n - 1) else 0 end, 7) as monetary_value from o"
query("rfm_summary", _P.format(w="") + " " + _S.format(end="(select max(period) from p)"))(lambda s, d: rounded(V.rfm_summary(orders(s, d), *O), "monetary_value", digits=7))
query("period_dedup", "select user_id as customer, cast(date_trunc('week', ts) as date) as period, round(sum(value), 4) as money from events where user_id is not null group by 1, 2")(lambda s, d: rounded(V.periods(events(s, d), "user_id", "ts", "value", "week"), "money", digits=4))
_H = ", s as (" + _S.format(end="date '1999-12-31'") + "), h as (select o_custkey as customer, count(distinct date_trunc('day', o_orderdate)) as fh, avg(o_totalprice) as mh from orders where cast(o_orderdate as date) > date '1999-12-31' and cast(o_orderdate as date) <= date '2001-06-30' group by 1) select s.*, coalesce(fh, 0) as frequency_holdout, round(coalesce(mh, 0), 7) as monetary_value_holdout, (date '2001-06-30' - date '1999-12-31')::double as duration_holdout from s left join h using (customer)"


def _holdout(s, d):
    return rounded(V.calibration_holdout(orders(s, d), *O, F.to_date(F.lit("1999-12-31")), F.to_date(F.lit("2001-06-30"))), "monetary_value", "monetary_value_holdout", digits=7)


query("calibration_holdout", _P.format(w=" where cast(o_orderdate as date) <= date '1999-12-31'") + _H)(_holdout)
query("calibration_holdout_means")(lambda s, d: _holdout(s, d).groupBy("frequency").agg(F.avg("frequency_holdout").alias("holdout"), F.count("*").alias("n")))
query(
    "cum_transactions",
    "with p as (select distinct o_custkey as c, cast(date_trunc('week', o_orderdate) as date) as period from orders), f as (select *, min(period) over (partition by c) as first from p), g as (select period, count(*) as n, count(*) filter (period > first) as repeat_n from f group by 1), k as (select cast(unnest(generate_series((select min(period) from g), (select max(period) from g), interval 7 day)) as date) as period), z as (select period, coalesce(n, 0) as n, coalesce(repeat_n, 0) as repeat_n from k left join g using (period)) select period, n, repeat_n, cast(sum(repeat_n) over (order by period) as bigint) as cumulative, repeat_n as incremental from z",
)(lambda s, d: V.cumulative_transactions(orders(s, d), "o_custkey", "o_orderdate"))
query("frequency_hist", _P.format(w="") + " select least(n - 1, 7) as frequency, count(*) as customers from o group by 1")(lambda s, d: V.frequency_histogram(orders(s, d), "o_custkey", "o_orderdate").withColumn("frequency", F.col("frequency").cast("bigint")))
_RFM = _P.format(w="") + ", r as (" + _S.format(end="(select max(period) from p)") + ")"
query("lifetime_value", _RFM + " select customer, round(monetary_value * (frequency / (t + 1)) * (select sum(1 / power(1.01, m)) from range(1, 13) x(m)), 3) as clv from r")(lambda s, d: rounded(V.lifetime_value(rounded(V.rfm_summary(orders(s, d), *O), "monetary_value", digits=7), 12, 0.01, F.col("frequency") / (F.col("t") + 1)), "clv", digits=3))
query("probability_alive", _RFM + " select customer, round(case when frequency = 0 then 1 else 1 / (1 + exp(ln(0.8::double) - ln(2.5 + greatest(frequency, 1) - 1) + (0.24 + frequency) * (ln(4.4 + t) - ln(4.4 + recency)))) end, 6) as alive from r")(lambda s, d: V.rfm_summary(orders(s, d), *O).select("customer", F.round(V.probability_alive(F.col("frequency"), F.col("recency"), F.col("t"), 0.24, 4.4, 0.8, 2.5), 6).alias("alive")))
query("summary_violations", _RFM + " select count(*) as n from r where frequency < 0 or recency < 0 or t < recency or (frequency = 0 and recency <> 0)")(lambda s, d: V.valid_summary(V.rfm_summary(orders(s, d), *O)).agg(F.count("*").alias("n")))
query("first_row_per_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")(lambda s, d: orders(s, d).groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey")))


def _tags(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.concat_ws(",", F.col("l_returnflag"), F.concat(F.lit(" "), F.col("l_linestatus"))).alias("tags"))


query("dummies_multilabel", "select l_orderkey, l_partkey, l_linenumber, " + ", ".join(f"(lower(l_returnflag) = '{k}' or lower(l_linestatus) = '{k}')::int as ta_{k}" for k in "afnor") + " from lineitem")(lambda s, d: E.dummies(_tags(s, d), "tags", E.categories(_tags(s, d), "tags")[0]))
query("dummies_infrequent", "select o_orderkey, (lower(o_orderpriority) = (select lower(o_orderpriority) from orders group by 1 order by count(*) desc, 1 limit 1))::int as top, (lower(o_orderpriority) <> (select lower(o_orderpriority) from orders group by 1 order by count(*) desc, 1 limit 1))::int as o_infrequent from orders")(
    lambda s, d: (lambda k: E.dummies(orders(s, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority", *k, prefix="o").withColumnRenamed(f"o_{k[0][0]}", "top"))(E.categories(orders(s, d), "o_orderpriority", max_categories=1))
)
query("dummies_inverse", "select l_orderkey, l_partkey, l_linenumber, list_aggregate(list_sort([lower(l_returnflag), lower(l_linestatus)]), 'string_agg', ',') as tags from lineitem")(lambda s, d: E.undo_dummies(E.dummies(_tags(s, d), "tags", E.categories(_tags(s, d), "tags")[0]), "ta", E.categories(_tags(s, d), "tags")[0], "tags").select("l_orderkey", "l_partkey", "l_linenumber", "tags"))
query("label_encode", "select event_id, event_type, (dense_rank() over (order by event_type) - 1)::int as code from events where event_type is not null union all select event_id, null, null from events where event_type is null")(lambda s, d: E.label_encode(events(s, d).select("event_id", "event_type"), "event_type", "code"))
query("missing_indicator", "select doc_id, (lang is null)::int as lang_missing, (n_chars is null)::int as n_chars_missing from documents")(lambda s, d: E.missing_indicator(t(s, d, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars"]).select("doc_id", "lang_missing", "n_chars_missing"))
for _k, _sql in (("mean", "avg(n_chars)"), ("median", "median(n_chars)"), ("most_frequent", "(select min(n_chars) from (select n_chars, count(*) as c from documents where n_chars is not null group by 1 qualify c = max(c) over ()))"), ("constant", "0")):
    _v = _sql if _k in ("most_frequent", "constant") else f"(select {_sql} from documents)"
    query(f"impute_{_k}", f"select doc_id, round(coalesce(n_chars, {_v})::double, 6) as n_chars from documents")(lambda s, d, k=_k: E.impute(t(s, d, "documents").select("doc_id", "n_chars"), "n_chars", k, 0).select("doc_id", F.round(F.col("n_chars").cast("double"), 6).alias("n_chars")))
query("unknown_labels", "select distinct lang as label from documents where lang is not null and lang not in (select iso_code from language_codes)")(lambda s, d: E.unknown_labels(t(s, d, "documents"), "lang", t(s, d, "language_codes"), "iso_code"))
query("unique_values", "select source as value, count(*) as n, (row_number() over (order by source nulls last) - 1)::int as code from documents group by 1")(lambda s, d: E.unique_values(t(s, d, "documents"), "source"))
query("union_all", "select n_name as name from nation union all select r_name from region")(lambda s, d: t(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(t(s, d, "region").select(F.col("r_name").alias("name"))))
query("intersect_keys", "select c_custkey as k from customer intersect select o_custkey from orders")(lambda s, d: t(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(orders(s, d).select("o_custkey")))
query("except_keys", "select p_partkey as k from part except select l_partkey from lineitem")(lambda s, d: t(s, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(t(s, d, "lineitem").select("l_partkey").distinct()))
query("provenance_override", "select input_path, coalesce(m.source_type, 'unknown') as source_type, count(*) as n from reader_files f left join collection_manifests m on f.collection_id = m.collection_id group by 1, 2")(lambda s, d: t(s, d, "reader_files").join(F.broadcast(t(s, d, "collection_manifests").select("collection_id", "source_type")), "collection_id", "left").groupBy("input_path", F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n")))
query("dummy_classifier", "select l_returnflag as label, round(count(*) / (select count(*) from lineitem), 6) as prior, count(*) = max(count(*)) over () as most_frequent from lineitem group by 1")(lambda s, d: t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n")).select("label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("prior"), (F.col("n") == F.max("n").over(Window.partitionBy(F.lit(1)))).alias("most_frequent")))
query("feature_ranking", "with x as (select 'quantity' as feature, corr(l_quantity, l_extendedprice) as r from lineitem union all select 'discount', corr(l_discount, l_extendedprice) from lineitem union all select 'tax', corr(l_tax, l_extendedprice) from lineitem) select feature, round(r, 6) as importance, (row_number() over (order by abs(r) desc, feature))::int as rank from x")(
    lambda s, d: (lambda x: x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("importance_raw")), "feature"))).select("feature", F.round("importance_raw", 6).alias("importance"), "rank"))(
        t(s, d, "lineitem").agg(*[F.corr(f"l_{c}", "l_extendedprice").alias(c) for c in ("quantity", "discount", "tax")]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance_raw")) for c in ("quantity", "discount", "tax")])).alias("z")).select("z.*")
    )
)
