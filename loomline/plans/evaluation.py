"""Queries on evaluation tables and curves, with their checking SQL.

Fixture: lineitem with y = (l_returnflag = 'R') and a score from the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark: SparkSession, d: str) -> DataFrame:
    df = t(spark, d, "lineitem")
    return df.select(*TIES, "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").alias("y"), (F.col("l_extendedprice") / 120000.0).alias("s"))


CLASSES = {"A": "s_a", "N": "s_n", "R": "s_r"}


def multiclass(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d)
    pred = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return df.withColumn("pred", pred).withColumn("s_a", F.floor(F.col("l_quantity")) / 50.0).withColumn("s_n", F.col("l_extendedprice") / 120000.0).withColumn("s_r", 1.0 - F.col("l_quantity") / 60.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


Y = F.col
_SCORED = "with s as (select *, l_returnflag = 'R' as y, l_extendedprice / 120000.0 as s from lineitem)"
_COUNTS = _SCORED + ", g as (select s as score, count(*) filter (y) as pos, count(*) filter (not y) as neg from s group by 1), c as (select score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from g window w as (order by score desc))"
_MULTI = "with m as (select *, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end as pred, floor(l_quantity) / 50.0 as s_a, l_extendedprice / 120000.0 as s_n, 1.0 - l_quantity / 60.0 as s_r from lineitem)"
_GRID = _MULTI + ", l as (select distinct x from (select l_returnflag as x from m union all select pred from m)), grid as (select a.x as truth, b.x as pred, (select count(*) from m where l_returnflag = a.x and m.pred = b.x) as n from l a, l b)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


query("confusion_matrix", _GRID + " select truth, pred, n from grid")(lambda s, d: M.confusion_matrix(multiclass(s, d), "l_returnflag", "pred"))
for _k, _w in (("true", "partition by truth"), ("pred", "partition by pred"), ("all", "")):
    query(f"confusion_matrix_{_k}", _GRID + f" select truth, pred, n, round(n / sum(n) over ({_w}), 6) as share from grid")(lambda s, d, k=_k: rounded(M.confusion_matrix(multiclass(s, d), "l_returnflag", "pred", normalize=k), "share"))
query(
    "classification_report",
    _MULTI
    + """, k as (select x as label, (select count(*) from m where l_returnflag = x and pred = x) as tp, (select count(*) from m where l_returnflag = x) as support, (select count(*) from m where pred = x) as called from (select distinct l_returnflag as x from m)),
 r as (select label, tp, support, coalesce(tp / nullif(called, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall, coalesce(2 * tp / nullif(called + support, 0), 0.0) as f1 from k),
 u as (select label, precision, recall, f1, support from r
 union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from r
 union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from r
 union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from r)
 select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from u""",
)(lambda s, d: rounded(M.classification_report(multiclass(s, d), "l_returnflag", "pred"), "precision", "recall", "f1"))
query("roc_curve", _COUNTS + " select score as threshold, round(fp / n, 9) as fpr, round(tp / p, 9) as tpr from c union all select 'Infinity'::double, 0.0, 0.0")(lambda s, d: rounded(M.roc_curve(scored(s, d), Y("y"), "s"), "fpr", "tpr", digits=9))
query("roc_auc", _COUNTS + " select round(sum(neg * (2 * tp - pos) / 2.0) / (max(p) * max(n)), 6) as auc, cast(max(p) as bigint) as n_pos, cast(max(n) as bigint) as n_neg from c")(lambda s, d: rounded(M.roc_auc(scored(s, d), Y("y"), "s"), "auc"))
query(
    "roc_auc_weighted",
    _SCORED + ", g as (select s as score, coalesce(sum(l_quantity) filter (y), 0) as pos, coalesce(sum(l_quantity) filter (not y), 0) as neg from s group by 1), c as (select *, sum(pos) over (order by score desc) as tp, sum(pos) over () as p, sum(neg) over () as n from g) select round(sum(neg * (2 * tp - pos) / 2.0) / (max(p) * max(n)), 6) as auc, max(p) as n_pos, max(n) as n_neg from c",
)(lambda s, d: rounded(M.roc_auc(scored(s, d), Y("y"), "s", "l_quantity"), "auc"))
query("pr_curve", _COUNTS + " select score as threshold, round(tp / (tp + fp), 9) as precision, round(tp / p, 9) as recall from c")(lambda s, d: rounded(M.pr_curve(scored(s, d), Y("y"), "s"), "precision", "recall", digits=9))
query("average_precision", _COUNTS + " select round(sum(pos * tp / (tp + fp)) / max(p), 6) as average_precision from c")(lambda s, d: rounded(M.average_precision(scored(s, d), Y("y"), "s"), "average_precision"))
query("gain_curve", _COUNTS + " select score, round((tp + fp) / (p + n), 9) as percentage, round(tp / p, 9) as gain from c union all select null, 0.0, 0.0")(lambda s, d: rounded(M.gain_curve(scored(s, d), Y("y"), "s"), "percentage", "gain", digits=9))
query("lift_curve", _COUNTS + " select score, round((tp + fp) / (p + n), 9) as percentage, round(tp / p / ((tp + fp) / (p + n)), 6) as lift from c")(lambda s, d: rounded(rounded(M.lift_curve(scored(s, d), Y("y"), "s"), "lift"), "percentage", digits=9))
_KS = _SCORED + ", g as (select s as score, count(*) filter (y) as pos, count(*) filter (not y) as neg from s group by 1), c as (select score as threshold, sum(neg) over w / sum(neg) over () as pct_neg, sum(pos) over w / sum(pos) over () as pct_pos from g window w as (order by score)), k as (select * from c union all select v, v, v from (values (0.0::double), (1.0::double)) e(v) where v not in (select threshold from c))"
query("ks_curve", _KS + " select threshold, round(pct_neg, 9) as pct_neg, round(pct_pos, 9) as pct_pos from k")(lambda s, d: rounded(M.ks_curve(scored(s, d), Y("y"), "s"), "pct_neg", "pct_pos", digits=9))
query("ks_statistic", _KS + " select round(pct_neg - pct_pos, 6) as ks, threshold from k order by pct_neg - pct_pos desc, threshold limit 1")(lambda s, d: rounded(M.ks_statistic(scored(s, d), Y("y"), "s"), "ks"))
_LONG = _MULTI + ", x as (select 'A' as class, l_returnflag = 'A' as y, s_a as s from m union all select 'N', l_returnflag = 'N', s_n from m union all select 'R', l_returnflag = 'R', s_r from m)"
query("roc_auc_ovr", _LONG + ", g as (select class, s, count(*) filter (y) as pos, count(*) filter (not y) as neg from x group by 1, 2), c as (select *, sum(pos) over (partition by class order by s desc) as tp from g) select class, round(sum(neg * (2 * tp - pos) / 2.0) / (sum(pos) * sum(neg)), 6) as auc from c group by 1")(lambda s, d: rounded(M.roc_auc_by_class(multiclass(s, d), "l_returnflag", CLASSES), "auc"))
query("roc_auc_micro", _LONG + ", g as (select s, count(*) filter (y) as pos, count(*) filter (not y) as neg from x group by 1), c as (select *, sum(pos) over (order by s desc) as tp from g) select round(sum(neg * (2 * tp - pos) / 2.0) / (sum(pos) * sum(neg)), 6) as auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from c")(lambda s, d: rounded(M.roc_auc_micro(multiclass(s, d), "l_returnflag", CLASSES), "auc"))
query("calibration_uniform", _SCORED + " select cast(greatest(0, least(floor(s * 10), 9)) as int) as bin, count(*) as n, round(avg(s), 6) as mean_predicted, round(avg(y::int), 6) as fraction_positive from s group by 1")(lambda s, d: rounded(M.calibration_curve(scored(s, d), Y("y"), "s"), "mean_predicted", "fraction_positive"))
query("calibration_quantile", _SCORED + ", e as (select unnest(quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as q from s), b as (select s, y, (select count(*) from e where s > q)::int as bin from s) select bin, count(*) as n, round(avg(s), 6) as mean_predicted, round(avg(y::int), 6) as fraction_positive from b group by 1")(lambda s, d: rounded(M.calibration_curve(scored(s, d), Y("y"), "s", strategy="quantile"), "mean_predicted", "fraction_positive"))
_TILES = _SCORED + ", r as (select s, y, ntile(10) over (order by s desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as decile from s), g as (select decile::int as decile, min(s) as prob_min, max(s) as prob_max, avg(s) as prob_avg, count(*) as cnt_cust, count(*) filter (y) as cnt_resp from r group by 1), c as (select *, cnt_cust - cnt_resp as cnt_non_resp, sum(cnt_cust) over w as cum_cust, sum(cnt_resp) over w as cum_resp, sum(cnt_cust) over () as n, sum(cnt_resp) over () as p from g window w as (order by decile))"
query(
    "decile_table",
    _TILES
    + """ select decile, prob_min, prob_max, round(prob_avg, 9) as prob_avg, cnt_cust, cnt_resp, cnt_non_resp, cast(cum_cust as bigint) as cum_cust, cast(cum_resp as bigint) as cum_resp, cast(cum_cust - cum_resp as bigint) as cum_non_resp,
 round(cnt_cust * p / n, 6) as cnt_resp_rndm, cast(least(cnt_cust, greatest(0, p - (cum_cust - cnt_cust))) as bigint) as cnt_resp_wiz, round(100.0 * cnt_resp / cnt_cust, 6) as resp_rate, round(100.0 * cum_resp / cum_cust, 6) as cum_resp_rate,
 round(100.0 * cum_cust / n, 6) as cum_cust_pct, round(100.0 * cum_resp / p, 6) as cum_resp_pct, round(100.0 * (cum_cust - cum_resp) / (n - p), 6) as cum_non_resp_pct, round(100.0 * cum_resp / p - 100.0 * (cum_cust - cum_resp) / (n - p), 6) as ks,
 round(cum_resp / p / (cum_cust / n), 6) as lift, round(cnt_resp / cnt_cust / (p / n), 6) as decile_lift from c""",
)(lambda s, d: rounded(rounded(M.decile_table(scored(s, d), Y("y"), "s", TIES), "cnt_resp_rndm", "resp_rate", "cum_resp_rate", "cum_cust_pct", "cum_resp_pct", "cum_non_resp_pct", "ks", "lift", "decile_lift"), "prob_avg", digits=9))
query(
    "ntile_financials",
    _TILES + ", f as (select decile, cast(cum_cust as bigint) as cum_cust, cast(cum_resp as bigint) as cum_resp, 1000.0::double + cum_cust * 2.0::double as investments, cum_resp * 7.5::double as revenues from c) select decile, cum_cust, cum_resp, investments, revenues, revenues - investments as profit, round((revenues - investments) / investments, 6) as roi from f",
)(lambda s, d: rounded(M.ntile_financials(M.decile_table(scored(s, d), Y("y"), "s", TIES), 1000.0, 2.0, 7.5), "roi"))
query(
    "modelplot_scores",
    _MULTI
    + """, x as (select l_linestatus, 'A' as target_class, (l_returnflag = 'A')::int as y, s_a as s, l_orderkey, l_linenumber, l_partkey, l_suppkey from m union all select l_linestatus, 'R', (l_returnflag = 'R')::int, s_r, l_orderkey, l_linenumber, l_partkey, l_suppkey from m),
 r as (select *, ntile(20) over (partition by l_linestatus, target_class order by s desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as ntile from x), g as (select l_linestatus, target_class, ntile::int as ntile, count(*) as n, cast(sum(y) as bigint) as pos from r group by 1, 2, 3),
 c as (select *, sum(n) over w as cum_n, sum(pos) over w as cum_pos, sum(n) over v as n_all, sum(pos) over v as pos_all from g window w as (partition by l_linestatus, target_class order by ntile), v as (partition by l_linestatus, target_class))
 select l_linestatus, target_class, ntile, n, pos, cast(cum_n as bigint) as cum_n, cast(cum_pos as bigint) as cum_pos, round(cum_pos / pos_all, 6) as gain, round(cum_pos / cum_n / (pos_all / n_all), 6) as cum_lift from c""",
)(lambda s, d: rounded(M.modelplot_scores(multiclass(s, d), ["l_linestatus"], "l_returnflag", {"A": "s_a", "R": "s_r"}, TIES, 20), "gain", "cum_lift"))
query("residual_summary", "with r as (select l_extendedprice - 1500.0 * l_quantity as r from lineitem) select count(*) as n, round(avg(r), 4) as mean, round(stddev_pop(r), 4) as std, round(min(r), 4) as min, round(max(r), 4) as max, round(quantile_cont(r, 0.25), 4) as q25, round(quantile_cont(r, 0.5), 4) as median, round(quantile_cont(r, 0.75), 4) as q75 from r")(
    lambda s, d: rounded(M.residual_summary(t(s, d, "lineitem").withColumn("p", F.lit(1500.0) * F.col("l_quantity")), "l_extendedprice", "p"), "mean", "std", "min", "max", "q25", "median", "q75", digits=4)
)
query(
    "silhouette",
    """with v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null),
 s as (select a.vec_id, a.label, b.label as other, sum(list_aggregate(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')) as d, count(*) as n from v a, v b group by 1, 2, 3),
 m as (select vec_id, label, max(case when other = label and n > 1 then d / (n - 1) end) as a, min(case when other <> label then d / n end) as b from s group by 1, 2)
 select label as cluster, count(*) as n, round(avg(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from m group by 1""",
)(lambda s, d: rounded(M.silhouette(t(s, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette"))
query("label_frequency", "select o_orderpriority as label, count(*) as n, round(count(*) / (select count(*) from orders), 6) as share from orders group by 1")(lambda s, d: rounded(M.label_frequency(t(s, d, "orders"), "o_orderpriority"), "share"))
query("missing_profile", "select 'lang' as column_name, count(*) filter (lang is null) as n_missing from documents union all select 'source', count(*) filter (source is null) from documents union all select 'n_chars', count(*) filter (n_chars is null) from documents")(lambda s, d: M.missing_profile(t(s, d, "documents").select("lang", "source", "n_chars")))
query(
    "interpolated_roc",
    _COUNTS + ", r as (select fp / n as x, max(tp / p) as y from c group by 1), z as (select x, y, lag(x) over (order by x) as x0, lag(y) over (order by x) as y0 from r), k as (select k / 20.0::double as g from range(21) t(k)) select g as x, round(coalesce((select y0 + (y - y0) * (g - x0) / (x - x0) from z where g > x0 and g <= x), case when g <= (select min(x) from r) then (select y from r order by x limit 1) else (select y from r order by x desc limit 1) end), 6) as y from k",
)(lambda s, d: rounded(M.interpolate(M.roc_curve(scored(s, d), Y("y"), "s").where("threshold < double('infinity')").groupBy("fpr").agg(F.max("tpr").alias("tpr")), "fpr", "tpr", [k / 20.0 for k in range(21)]), "y"))
