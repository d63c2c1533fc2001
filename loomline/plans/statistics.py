"""Queries on statistics, with their checking SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import stats as S
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


_MED = "with m as (select o_orderpriority, median(o_totalprice) as med from orders group by 1), d as (select o.o_orderpriority, o_totalprice as x, med, abs(o_totalprice - med) as dev from orders o join m using (o_orderpriority)), a as (select o_orderpriority, median(dev) as mad from d group by 1), z as (select d.*, mad from d join a using (o_orderpriority))"
query("mad_std", _MED + " select o_orderpriority, count(*) as n, round(max(med), 4) as median, round(max(mad), 4) as mad, round(max(mad) * 1.482602218505602::double, 4) as mad_std from z group by 1")(lambda s, d: rounded(S.mad_std(t(s, d, "orders"), "o_totalprice", ["o_orderpriority"]), "median", "mad", "mad_std", digits=4))
query(
    "biweight",
    _MED + """, u as (select *, (x - med) / (6 * mad) as ul, (x - med) / (9 * mad) as us from z), b as (select o_orderpriority, max(med) + sum((x - med) * (1 - ul**2)**2) filter (ul**2 < 1) / sum((1 - ul**2)**2) filter (ul**2 < 1) as loc,
 count(*) * sum((x - med)**2 * (1 - us**2)**4) filter (us**2 < 1) / (sum((1 - us**2) * (1 - 5 * us**2)) filter (us**2 < 1))**2 as var from u group by 1)
 select o_orderpriority, round(loc, 4) as biweight_location, round(var, 0) as biweight_midvariance, round(sqrt(var), 4) as biweight_scale from b""",
)(lambda s, d: rounded(rounded(S.biweight(t(s, d, "orders"), "o_totalprice", ["o_orderpriority"]), "biweight_location", "biweight_scale", digits=4), "biweight_midvariance", digits=0))
query(
    "biweight_midcorrelation",
    """with x as (select l_quantity as a, l_extendedprice as b from lineitem), m as (select median(a) as ma, median(b) as mb from x), d as (select a - ma as a, b - mb as b from x, m), k as (select median(abs(a)) as ka, median(abs(b)) as kb from d),
 u as (select a, b, (a / (9 * ka))**2 as ua, (b / (9 * kb))**2 as ub from d, k), v as (select case when ua < 1 then a * (1 - ua)**2 else 0 end as na, case when ub < 1 then b * (1 - ub)**2 else 0 end as nb, case when ua < 1 then (1 - ua) * (1 - 5 * ua) else 0 end as da, case when ub < 1 then (1 - ub) * (1 - 5 * ub) else 0 end as db from u)
 select round(count(*) * sum(na * nb) / (sum(da) * sum(db)), 3) as midcovariance, round(sum(na * nb) / sqrt(sum(na * na) * sum(nb * nb)), 6) as midcorrelation from v""",
)(lambda s, d: rounded(rounded(S.biweight_midcorrelation(t(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "midcorrelation"), "midcovariance", digits=3))
_ANGLE = "(extract(hour from ts) + extract(minute from ts) / 60.0::double) * 2 * pi() / 24"
query(
    "circular_stats",
    f"""with x as (select event_type, {_ANGLE} as x from events), a as (select event_type, count(*) as n, avg(cos(x)) as c, avg(sin(x)) as s, avg(cos(2 * x)) as c2, avg(sin(2 * x)) as s2 from x group by 1), r as (select *, sqrt(c * c + s * s) as r from a)
 select event_type, n, round(atan2(s, c), 6) as circmean, round(1 - r, 6) as circvar, round(sqrt(-2 * ln(r)), 6) as circstd, round(sqrt(2 * (1 - r)), 6) as angular_std, round(atan2(s2, c2), 6) as moment2_angle, round(sqrt(c2 * c2 + s2 * s2), 6) as moment2_length,
 round(exp(-n * r * r) * case when n < 50 then 1 + (2 * n * r**2 - (n * r**2)**2) / (4 * n) - (24 * n * r**2 - 132 * (n * r**2)**2 + 76 * (n * r**2)**3 - 9 * (n * r**2)**4) / (288 * n * n) else 1 end, 6) as rayleigh_p,
 round(case when r < 0.53 then 2 * r + r**3 + 5 * r**5 / 6 when r < 0.85 then -0.4 + 1.39 * r + 0.43 / (1 - r) else 1 / (r**3 - 4 * r**2 + 3 * r) end, 6) as vonmises_kappa from r""",
)(lambda s, d: rounded(S.circular(t(s, d, "events"), (F.hour("ts") + F.minute("ts") / F.lit(60.0)) * 2 * math.pi / 24, ["event_type"]), "circmean", "circvar", "circstd", "angular_std", "moment2_angle", "moment2_length", "rayleigh_p", "vonmises_kappa"))
query("circular_correlation", f"with x as (select {_ANGLE} as a, value / 10 as b from events where value is not null), m as (select atan2(avg(sin(a)), avg(cos(a))) as ma, atan2(avg(sin(b)), avg(cos(b))) as mb from x) select round(sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(sin(a - ma)**2) * sum(sin(b - mb)**2)), 6) as circcorr from x, m")(
    lambda s, d: rounded(S.circular_correlation(t(s, d, "events"), (F.hour("ts") + F.minute("ts") / F.lit(60.0)) * 2 * math.pi / 24, F.col("value") / 10), "circcorr")
)
_HIST = ", g as (select lo, dx, unnest(range(bins))::int as bin from s), c as (select least(bins - 1, floor((o_totalprice - lo) / dx))::int as bin, count(*) as n from orders, s where o_totalprice is not null group by 1) select bin, round(lo + bin * dx, 4) as low, round(lo + (bin + 1) * dx, 4) as high, coalesce(n, 0) as n from g left join c using (bin)"
_WIDTHS = {
    "freedman": "with q as (select min(o_totalprice) as lo, max(o_totalprice) as hi, 2 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / pow(count(o_totalprice), 1.0::double / 3) as dx from orders), s as (select lo, dx, greatest(1, ceil(hi / dx - lo / dx))::int as bins from q)",
    "scott": "with q as (select min(o_totalprice) as lo, max(o_totalprice) as hi, 3.5::double * stddev_pop(o_totalprice) / pow(count(o_totalprice), 1.0::double / 3) as dx from orders), s as (select lo, dx, greatest(1, ceil(hi / dx - lo / dx))::int as bins from q)",
    "fixed": "with s as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 20 as dx, 20 as bins from orders)",
}
for _k, _sql in _WIDTHS.items():
    query(f"hist_{_k}", _sql + _HIST)(lambda s, d, k=_k: rounded(S.histogram(t(s, d, "orders"), "o_totalprice", 20 if k == "fixed" else k), "low", "high", digits=4))
_CLIP = "with c0 as (select power(o_totalprice / 100000, 3) as x from orders where o_totalprice is not null)" + "".join(f", b{i} as (select median(x) as m, stddev_pop(x) as s from c{i}), c{i + 1} as (select x from c{i}, b{i} where x between m - 2 * s and m + 2 * s)" for i in range(5))
query("sigma_clipped_stats", _CLIP + " select round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, count(*) as n, round(median(x), 5) as median from c5")(lambda s, d: rounded(S.sigma_clipped_stats(t(s, d, "orders").select(F.pow(F.col("o_totalprice") / 100000, F.lit(3)).alias("x")), "x", 2.0), "mean", "std", "median", digits=5))
query("jackknife_mean", "with x as (select c_mktsegment, c_acctbal as x, count(*) over w as n, sum(c_acctbal) over w as t from customer window w as (partition by c_mktsegment)), l as (select *, (t - x) / (n - 1) as loo from x) select c_mktsegment, round(max(t) / max(n) - (max(n) - 1) * (avg(loo) - max(t) / max(n)), 4) as estimate, round((max(n) - 1) * (avg(loo) - max(t) / max(n)), 4) + 0.0 as bias, round(sqrt((max(n) - 1) * var_pop(loo)), 4) as std_err from l group by 1")(
    lambda s, d: rounded(S.jackknife_mean(t(s, d, "customer"), "c_acctbal", ["c_mktsegment"]), "estimate", "bias", "std_err", digits=4).withColumn("bias", F.col("bias") + 0.0)
)
query("bootstrap_mean")(lambda s, d: S.bootstrap_mean(t(s, d, "orders"), "o_totalprice", "o_orderkey"))
query("binned_binomial", "with b as (select least(9, floor(l_quantity / 50.0 * 10))::int as bin, count(*) as n, count(*) filter (l_returnflag = 'R') as k from lineitem where l_quantity between 0 and 50 group by 1), p as (select bin, n, k, k / n as p, (k + 0.5) / (n + 1.0) as mid, sqrt(n) / (n + 1.0) * sqrt(k / n * (1 - k / n) + 1 / (4.0 * n)) as h from b) select bin, n, round(p, 6) as p, round(greatest(mid - h, 0), 6) as low, round(least(mid + h, 1), 6) as high from p")(
    lambda s, d: rounded(S.binned_binomial(t(s, d, "lineitem"), F.col("l_quantity"), F.col("l_returnflag") == "R", 0.0, 50.0, 10), "p", "low", "high")
)


def _poisson(s, d):
    c = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    cols = {}
    for kind in ("root-n", "root-n-0", "pearson"):
        low, high = S.poisson_interval(F.col("n"), 1.0, kind)
        cols |= {f"{kind.replace('-', '_')}_low": F.round(low, 6), f"{kind.replace('-', '_')}_high": F.round(high, 6)}
    return c.select("user_id", "n", *[v.alias(k) for k, v in cols.items()])


query("poisson_intervals", "with c as (select user_id, count(*) as n from events group by 1) select user_id, n, round(n - sqrt(n), 6) as root_n_low, round(n + sqrt(n), 6) as root_n_high, round(n - sqrt(n), 6) as root_n_0_low, round(n + sqrt(n), 6) as root_n_0_high, round(n + 0.5 - sqrt(n + 0.25), 6)::double as pearson_low, round(n + 0.5 + sqrt(n + 0.25), 6)::double as pearson_high from c")(_poisson)
query("kuiper", "with x as (select (extract(hour from ts) * 60 + extract(minute from ts)) / 1440.0::double as x from events), c as (select x, count(*) as c from x group by 1), r as (select x, c, sum(c) over (order by x) as hi, sum(c) over () as n from c) select round(max(hi / n - x) + max(x - (hi - c) / n), 6) as d, cast(max(n) as bigint) as n from r")(
    lambda s, d: rounded(S.kuiper(t(s, d, "events"), (F.hour("ts") * 60 + F.minute("ts")) / F.lit(1440.0)), "d")
)
query("information_criteria", "with a as (select count(*) as n, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity)**2 / regr_sxx(l_extendedprice, l_quantity) as ssr from lineitem) select n, round(ssr / 1e6, 2) as ssr, round(n * ln(ssr / n) + 2 * ln(n), 3) as bic, round(n * ln(ssr / n) + 4, 3) as aic from a")(
    lambda s, d: rounded(rounded(S.information_criteria(t(s, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("ssr", F.col("ssr") / 1e6), "ssr", digits=2), "bic", "aic", digits=3)
)
query(
    "ripley_k",
    "with p as (select c_custkey as id, (c_acctbal + 1000) / 11000 as x, (c_custkey * 7919 % 1000) / 1000.0::double as y from customer), d as (select sqrt((a.x - b.x)**2 + (a.y - b.y)**2) as d from p a join p b on a.id < b.id), r as (select unnest([0.01, 0.03, 0.05]::double[]) as radius), k as (select radius, 2 * (select count(*) from d where d <= radius) / ((select count(*) from p) * ((select count(*) from p) - 1)) as k from r) select radius, round(k, 8) as k, round(sqrt(k / pi()), 6) as l, round(sqrt(k / pi()) - radius, 6) as h, round(pi() * radius**2, 8) as poisson from k",
)(lambda s, d: rounded(rounded(S.ripley_k(t(s, d, "customer"), "c_custkey", (F.col("c_acctbal") + 1000) / 11000, (F.col("c_custkey") * 7919 % 1000) / F.lit(1000.0), [0.01, 0.03, 0.05], 1.0), "l", "h"), "k", "poisson", digits=8))


def _hours(s, d):
    hour = F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600
    return t(s, d, "events").groupBy("event_type", hour.alias("h")).agg(F.count("*").alias("n"), F.avg("value").alias("value"), (50 / F.sqrt(F.count("value"))).alias("sigma"))


def _ticks(s, d):
    """Every hour between the first and the last one, with or without an event of the type."""
    x = _hours(s, d)
    span = x.groupBy("event_type").agg(F.min("h").cast("long").alias("a"), F.max("h").cast("long").alias("z"))
    every = span.select("event_type", F.explode(F.transform(F.sequence("a", "z"), lambda h: h.cast("double"))).alias("h"))
    return every.join(x, ["event_type", "h"], "left").select("event_type", "h", F.col("n").isNotNull().cast("int").alias("hit"))


query("bayesian_blocks")(lambda s, d: B.bayesian_blocks(_hours(s, d), "event_type", "h", "n"))
query("bayesian_blocks_ticks")(lambda s, d: B.bayesian_blocks(_ticks(s, d), "event_type", "h", "hit", "ticks"))
query("bayesian_blocks_measures")(lambda s, d: B.bayesian_blocks(_hours(s, d).where("value is not null"), "event_type", "h", "value", "measures", "sigma"))
query("softmax_group", "with m as (select l_orderkey, max(l_discount) as m from lineitem group by 1), z as (select l_orderkey, ln(sum(exp(l_discount - m))) + max(m) as lse from lineitem join m using (l_orderkey) group by 1) select l_orderkey, l_linenumber, l_partkey, l_discount, round(lse, 6) as logsumexp, round(exp(l_discount - lse), 6) as softmax, round(l_discount - lse, 6) as log_softmax from lineitem join z using (l_orderkey)")(
    lambda s, d: rounded(S.softmax(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), "l_orderkey", "l_discount"), "logsumexp", "softmax", "log_softmax")
)
query("minmax_scale", "select s_suppkey, s_acctbal, round((s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over ()), 6) as scaled from supplier")(lambda s, d: rounded(S.minmax_scale(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal"), "scaled"))
query("explained_variance", "with v as (select o_orderpriority as component, var_pop(o_totalprice) as v from orders group by 1) select component, round(v / sum(v) over (), 6) as ratio, round(sum(v) over (order by component) / sum(v) over (), 6) as cumulative, sum(v) over (order by component) / sum(v) over () >= 0.7 as reaches from v")(
    lambda s, d: rounded(S.explained_variance(t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("component")).agg(F.var_pop("o_totalprice").alias("v")), "component", "v", 0.7), "ratio", "cumulative")
)
