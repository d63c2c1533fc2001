"""Queries on evaluation by group, validation, residual families and baselines, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped as G
from ..operators import metrics as M
from ..operators import modeling as K
from .evaluation import TIES, multiclass, rounded, scored, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_S = "with s as (select *, l_returnflag = 'R' as y, l_extendedprice / 120000.0 as s from lineitem)"
_G = _S + """, g as (select l_linestatus as g, s, coalesce(sum(l_quantity) filter (y), 0) as pos, coalesce(sum(l_quantity) filter (not y), 0) as neg from s group by 1, 2),
 c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from g window w as (partition by g order by s desc), a as (partition by g))"""
query("roc_pr_by_hue", _G + " select g as l_linestatus, s as threshold, round(fp / n, 8) as fpr, round(tp / p, 8) as tpr, round(tp / (tp + fp), 8) as precision from c")(
    lambda s, d: rounded(G.curves_by_group(scored(s, d), "l_linestatus", F.col("y"), "s", "l_quantity").select("l_linestatus", "threshold", "fpr", "tpr", "precision"), "fpr", "tpr", "precision", digits=8)
)
query("scores_by_hue", _G + " select g as l_linestatus, round(sum(neg * (2 * tp - pos) / 2) / (max(p) * max(n)), 6) as auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) as average_precision, round(max(tp / p - fp / n), 6) as ks from c group by 1")(
    lambda s, d: rounded(G.scores_by_group(scored(s, d), "l_linestatus", F.col("y"), "s", "l_quantity"), "auc", "average_precision", "ks")
)


def _folded(s, d):
    return scored(s, d).withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))


_F = _S + """, g as (select (l_orderkey % 5)::int as fold, s, count(*) filter (y) as pos, count(*) filter (not y) as neg from s group by 1, 2),
 c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from g window w as (partition by fold order by s desc), a as (partition by fold)),
 k as (select fold, sum(neg * (2 * tp - pos) / 2.0) / (max(p) * max(n)) as auc, sum(pos * tp / (tp + fp)) / max(p) as ap, max(tp / p - fp / n) as ks from c group by 1)"""
query("cv_scores", _F + " select fold, round(auc, 6) as auc, round(ap, 6) as average_precision, round(ks, 6) as ks from k")(lambda s, d: rounded(G.scores_by_group(_folded(s, d), "fold", F.col("y"), "s"), "auc", "average_precision", "ks"))
query("cv_summary", _F + " select round(avg(auc), 6) as auc_mean, round(avg(ks), 6) as ks_mean, round(stddev_pop(auc), 6) as auc_std, round(stddev_pop(ks), 6) as ks_std from k")(
    lambda s, d: rounded(G.fold_summary(G.scores_by_group(_folded(s, d), "fold", F.col("y"), "s"), "auc", "ks"), "auc_mean", "ks_mean", "auc_std", "ks_std")
)
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
query("one_hot_truth", f"select {_KEYS}, [(l_returnflag = 'A')::int, (l_returnflag = 'N')::int, (l_returnflag = 'R')::int] as y from lineitem")(lambda s, d: G.one_hot_truth(t(s, d, "lineitem").select(*TIES, "l_returnflag"), "l_returnflag").select(*TIES, "y"))
query("binary_truth", f"select {_KEYS}, l_linestatus = 'O' as y from lineitem")(lambda s, d: G.one_hot_truth(t(s, d, "lineitem").select(*TIES, "l_linestatus"), "l_linestatus").select(*TIES, "y"))
query("class_score", f"select {_KEYS}, round((l_tax - (select min(l_tax) from lineitem)) / ((select max(l_tax) from lineitem) - (select min(l_tax) from lineitem)), 6) as s from lineitem")(
    lambda s, d: rounded(G.class_score(t(s, d, "lineitem").select(*TIES, F.array("l_discount", "l_tax").alias("p")), "p", 1, True).select(*TIES, "s"), "s")
)
query("prepare_subset", "select doc_id, lang, n_chars::double as n_chars from documents where lang is not null and n_chars is not null")(lambda s, d: G.prepare_subset(t(s, d, "documents").select("doc_id", "lang", "n_chars"), "lang", ["n_chars"]))
query(
    "residual_families",
    """with r as (select l_extendedprice - 1500.0::double * l_quantity as r from lineitem), m as (select median(r) as med from r),
    s as (select avg(r) as m, stddev_pop(r) as sd, max(med) as med, avg(abs(r - med)) as mad, min(r) as lo, max(r) as hi, avg(abs(r)) as a, avg(ln(abs(nullif(r, 0)))) as lm, stddev_pop(ln(abs(nullif(r, 0)))) as ls from r, m)
    select family, round(a, 3) as a, round(b, 3) as b from (
    select 'normal' as family, m as a, sd as b from s union all select 'laplace', med, mad from s union all select 'logistic', m, sd * sqrt(3) / pi() from s
    union all select 'gumbel', m - 0.5772156649015329 * sd * sqrt(6) / pi(), sd * sqrt(6) / pi() from s union all select 'uniform', lo, hi from s union all select 'exponential', 0, a from s union all select 'lognormal', lm, ls from s)""",
)(lambda s, d: rounded(G.fit_families(t(s, d, "lineitem").withColumn("p", F.lit(1500.0) * F.col("l_quantity")), "l_extendedprice", "p"), "a", "b", digits=3))
query("probability_plot")(lambda s, d: G.probability_plot(t(s, d, "orders"), "o_totalprice", 19))
_W = "with c as (select l_extendedprice as x, sum(l_quantity) as w from lineitem group by 1), r as (select x, sum(w) over (order by x) as cum, sum(w) over () as a from c)"
for _k, _sql in {
    "mean": "select round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as prediction from lineitem",
    "median": _W + " select min(x) filter (cum >= 0.5 * a) as prediction from r",
    "quantile": _W + " select min(x) filter (cum >= 0.9 * a) as prediction from r",
    "constant": "select 0.9::double as prediction",
}.items():
    query(f"dummy_regressor_{_k}", _sql)(lambda s, d, k=_k: rounded(G.dummy_regressor(t(s, d, "lineitem"), "l_extendedprice", k, 0.9, "l_quantity"), "prediction", digits=4))
query("dummy_regressor_unweighted", "select round(quantile_cont(o_totalprice, 0.25), 4) as prediction from orders")(lambda s, d: rounded(G.dummy_regressor(t(s, d, "orders"), "o_totalprice", "quantile", 0.25), "prediction", digits=4))
query(
    "silhouette_euclidean",
    """with v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null),
    s as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.e, b.e)) as d, count(*) as n from v a, v b where a.vec_id % 100 = 0 group by 1, 2, 3),
    m as (select vec_id, label, max(case when other = label and n > 1 then d / (n - 1) end) as a, min(case when other <> label then d / n end) as b from s group by 1, 2)
    select vec_id, label::varchar as cluster, round(a, 5) as a, round(b, 5) as b, round(case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end, 5) as silhouette from m""",
)(lambda s, d: rounded(G.silhouette_of(t(s, d, "embeddings").where("vec_id % 100 = 0"), t(s, d, "embeddings"), "vec_id", "embedding", "label"), "a", "b", "silhouette", digits=5))
query("describe_tiles", "select * from (values " + ", ".join(f"({i}, '{c}', '{m}')" for i, (c, m) in enumerate(G.TILE_COLUMNS.items())) + ") v(position, column_name, meaning)")(lambda s, d: G.describe_tiles(M.decile_table(scored(s, d), F.col("y"), "s", TIES)))
_TILES = """with m as (select *, floor(l_quantity) / 50.0 as s_a, 1.0 - l_quantity / 60.0 as s_r from lineitem),
 x as (select l_linestatus, 'A' as target_class, (l_returnflag = 'A')::int as y, s_a as s, l_orderkey, l_linenumber, l_partkey, l_suppkey from m union all select l_linestatus, 'R', (l_returnflag = 'R')::int, s_r, l_orderkey, l_linenumber, l_partkey, l_suppkey from m),
 r as (select *, ntile(20) over (partition by l_linestatus, target_class order by s desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as ntile from x),
 g as (select l_linestatus, target_class, ntile::int as ntile, count(*) as n, sum(y) as pos from r group by 1, 2, 3),
 c as (select *, sum(n) over w as cum_n, sum(pos) over w as cum_pos, sum(n) over v as n_all, sum(pos) over v as pos_all from g window w as (partition by l_linestatus, target_class order by ntile), v as (partition by l_linestatus, target_class))"""


def _tiles(s, d):
    return M.modelplot_scores(multiclass(s, d), ["l_linestatus"], "l_returnflag", {"A": "s_a", "R": "s_r"}, TIES, 20)


query("tile_series", _TILES + " select l_linestatus, target_class, ntile, round(cum_pos / pos_all, 6) as cumgains, round(cum_pos / cum_n / (pos_all / n_all), 6) as cumlift, round(pos / n, 6) as response, round(cum_pos / cum_n, 6) as cumresponse from c")(
    lambda s, d: rounded(G.tile_series(_tiles(s, d), ["l_linestatus", "target_class"]), "cumgains", "cumlift", "response", "cumresponse")
)
query("plotting_scope", _TILES + " select l_linestatus as dataset, target_class, ntile, n, pos::bigint as pos from c where l_linestatus = 'O'")(
    lambda s, d: G.plotting_scope(_tiles(s, d).withColumnRenamed("l_linestatus", "dataset"), "compare_targetclasses", dataset="O").select("dataset", "target_class", "ntile", "n", "pos")
)
query("learning_curve")(lambda s, d: G.learning_curve(t(s, d, "lineitem").where("l_linenumber = 1"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "l_linestatus", [0.25, 1.0], 2))


def _labels(s, d):
    return t(s, d, "lineitem").select(*TIES, F.concat_ws(",", "l_returnflag", "l_linestatus").alias("l_tags"), F.col("l_linestatus").alias("l_tail"), F.col("l_returnflag").alias("flags"))


_FLAG = lambda c, k: f"(lower({c}) = '{k}')"
query(
    "dummies_names",
    f"select {_KEYS}, "
    + ", ".join([f"(lower(l_returnflag) = '{k}' or lower(l_linestatus) = '{k}')::double as l_tags_{k}" for k in "afnor"] + [f"(lower(l_linestatus) = '{k}')::double as l_tail_{k}" for k in "fo"] + [f"(lower(l_returnflag) = '{k}')::double as fl_{k}" for k in "anr"])
    + " from lineitem",
)(lambda s, d: G.dummies_of(_labels(s, d), ["l_tags", "l_tail", "flags"], "double"))
query(
    "dummies_sparse",
    f"select {_KEYS}, list_filter([" + ", ".join([f"case when lower(l_returnflag) = '{k}' or lower(l_linestatus) = '{k}' then {i} end" for i, k in enumerate("afnor")] + [f"case when lower(l_linestatus) = '{k}' then {i + 5} end" for i, k in enumerate("fo")] + [f"case when lower(l_returnflag) = '{k}' then {i + 7} end" for i, k in enumerate("anr")]) + "], lambda x: x is not null) as indicator_ids from lineitem",
)(lambda s, d: G.dummies_of(_labels(s, d), ["l_tags", "l_tail", "flags"], sparse=True))
query(
    "dummies_bool",
    f"select {_KEYS}, l_linestatus = 'F' as l__f, l_linestatus = 'O' as l__o from lineitem",
)(lambda s, d: G.dummies_of(_labels(s, d).select(*TIES, "l_tail"), ["l_tail"], "boolean"))
ORACLE["selection_summary"] = (
    _S
    + """, r as (select s, y, ntile(10) over (order by s desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as decile from s), g as (select decile, count(*) as n, count(*) filter (y) as p from r group by 1)
 select sum(n)::bigint as customers, sum(p)::bigint as responders, sum(p) / sum(n) as response, (sum(p) / (select sum(p) from g)) / (sum(n) / (select sum(n) from g)) as lift from g where decile <= 3"""
)
ORACLE["calibration_holdout_means"] = """with p as (select o_custkey as customer, cast(date_trunc('day', o_orderdate) as date) as period from orders where cast(o_orderdate as date) <= date '1999-12-31' group by 1, 2),
 o as (select customer, count(*) - 1 as frequency from p group by 1), h as (select o_custkey as customer, count(distinct date_trunc('day', o_orderdate)) as fh from orders where cast(o_orderdate as date) > date '1999-12-31' and cast(o_orderdate as date) <= date '2001-06-30' group by 1)
 select frequency, avg(coalesce(fh, 0)) as holdout, count(*) as n from o left join h using (customer) group by 1"""
query("cv_confusion_keys", "with c as (select (l_orderkey % 5)::int as fold, l_returnflag as truth, l_linestatus as pred, count(*) as n from lineitem group by 1, 2, 3) select fold, truth, pred, n, round(n / sum(n) over (partition by fold, truth), 6) as share from c")(
    lambda s, d: rounded(K.confusion_by_fold(scored(s, d), (F.col("l_orderkey") % 5).cast("int"), "l_returnflag", "l_linestatus"), "share")
)
ORACLE["impute_neighbours"] = """with e as (select vec_id, embedding::double[] as v, case when vec_id % 100 <> 0 then label end as label from embeddings),
 p as (select a.vec_id, b.label, row_number() over (partition by a.vec_id order by round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 8) desc, b.vec_id) as r from e a, e b where a.label is null and b.label is not null),
 f as (select vec_id, avg(label) as f from p where r <= 5 group by 1)
 select vec_id, coalesce(label::double, f) as label from e left join f using (vec_id)"""
ORACLE["knuth_bins"] = """with s as (select count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders where o_totalprice is not null), m as (select m from range(1, 121) r(m)),
 c as (select m, least(m - 1, floor((o_totalprice - lo) / (hi - lo) * m)) as b, count(*) as k from orders, s, m where o_totalprice is not null group by 1, 2),
 g as (select m, sum(lgamma(k + 0.5::double) - lgamma(0.5::double)) as g from c group by 1), z as (select m, n * ln(m) + lgamma(m / 2.0::double) - lgamma(n + m / 2.0::double) + g as score from g, s)
 select m::int as bins from z order by score desc, m limit 1"""
