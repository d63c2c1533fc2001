"""Queries on purchase models, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clv as V
from ..operators import purchase as P
from .evaluation import rounded, t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MODEL = P.Purchases(0.24, 4.4, 0.8, 2.5)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def orders(s, d):
    return t(s, d, "orders")


O = ("o_custkey", "o_orderdate", "o_totalprice")
_WEEKS = "with p as (select distinct o_custkey as c, cast(date_trunc('week', o_orderdate) as date) as w from orders where o_custkey is not null and o_orderdate is not null), f as (select c, min(w) as first from p group by 1), z as (select min(w) as a, max(w) as z from p)"
query(
    "alive_path",
    _WEEKS
    + """, k as (select c, first, cast(unnest(generate_series(first::timestamp, z::timestamp, interval 7 day)) as date) as period from f, z),
    j as (select k.c, k.first, period, (p.w is not null)::int as hit, p.w from k left join p on p.c = k.c and p.w = period),
    h as (select c, period, sum(hit) over q - 1 as f, (max(w) over q - first) / 7.0::double as r, (period - first) / 7.0::double as t from j window q as (partition by c order by period))
    select c as customer, period, f::int as frequency, r as recency, t, round(case when f = 0 then 1 else 1 / (1 + exp(ln(0.8::double) - ln(2.5 + greatest(f, 1) - 1) + (0.24 + f) * (ln(4.4 + t) - ln(4.4 + r)))) end, 6) as alive from h""",
)(lambda s, d: rounded(P.alive_path(orders(s, d), "o_custkey", "o_orderdate", MODEL), "alive"))
query(
    "actual_and_predicted",
    _WEEKS
    + """, k as (select cast(unnest(generate_series(a::timestamp, z::timestamp, interval 7 day)) as date) as period from z), n as (select w, count(*) as n from p join f using (c) where w > first group by 1), o as (select first, count(*) as size from f group by 1),
    e as (select period, coalesce(sum(size * 0.05 * (period - first) / 7.0::double), 0) as predicted from k left join o on first < period group by 1)
    select period, sum(coalesce(n, 0)) over (order by period)::bigint as actual, round(predicted, 4) as predicted from e left join n on w = period""",
)(lambda s, d: rounded(P.expected_cumulative(orders(s, d), "o_custkey", "o_orderdate", lambda age: age * 0.05), "predicted", digits=4))
query("predicted_by_model")(lambda s, d: rounded(P.expected_cumulative(orders(s, d), "o_custkey", "o_orderdate", lambda age: P.expected_new(age, MODEL)), "predicted"))
query(
    "compare_counts",
    """with c as (select o_custkey, count(distinct cast(o_orderdate as date)) - 1 as f from orders where o_custkey is not null group by 1), h as (select least(f, 7) as frequency, count(*) as n from c group by 1),
    m as (select frequency, round(1000 * pow(0.8::double, frequency), 4) as n from range(0, 6) r(frequency)) select h.frequency, h.n as actual, m.n as model from h join m using (frequency)""",
)(
    lambda s, d: P.compare_counts(
        V.frequency_histogram(orders(s, d), "o_custkey", "o_orderdate").select(F.col("frequency").cast("bigint").alias("frequency"), F.col("customers").alias("n")),
        s.range(6).select(F.col("id").alias("frequency"), F.round(1000 * F.pow(F.lit(0.8), F.col("id")), 4).alias("n")),
        "frequency",
        "n",
    )
)
query(
    "rate_heterogeneity",
    """with u as (select i / 100.0::double as u from range(1, 100) r(i)), x as (select 'rate' as kind, u * ((0.24 + 4 * sqrt(0.24)) / 4.4) as x from u union all select 'leave', u from u)
    select kind, round(x, 8) as x, round(case kind when 'rate' then exp(0.24::double * ln(4.4) - lgamma(0.24) + (0.24::double - 1) * ln(x) - 4.4::double * x) else exp(lgamma(3.3) - lgamma(0.8) - lgamma(2.5) + (0.8::double - 1) * ln(x) + 1.5::double * ln(1 - x)) end, 5) as density from x""",
)(lambda s, d: rounded(rounded(P.heterogeneity(s, MODEL), "x", digits=8), "density", digits=5))


def _summary(s, d):
    return V.rfm_summary(orders(s, d), *O)


_RFM = "with p as (select o_custkey as customer, cast(o_orderdate as date) as day, sum(o_totalprice) as money from orders where o_custkey is not null group by 1, 2), o as (select customer, count(*) as n, min(day) as first, max(day) as last, sum(money) as total, arg_min(money, day) as fm from p group by 1), r as (select customer, n - 1 as f, case when n > 1 then (total - fm) / (n - 1) else 0 end as m from o)"
query("customer_value", _RFM + " select customer, round(" + " + ".join(f"m * f * 0.3 / pow(1.01::double, {k})" for k in range(1, 7)) + ", 2) as clv from r")(
    lambda s, d: rounded(P.customer_value(_summary(s, d), lambda ahead: F.col("frequency") * ahead * 0.01, 6), "clv", digits=2)
)
query("customer_value_model")(lambda s, d: P.customer_value(_summary(s, d), lambda h: P.expected_more(h, F.col("frequency"), F.col("recency"), F.col("t"), P.Purchases(2.0, 900.0, 0.4, 4.0)), 3))
query("expectation_grid")(lambda s, d: s.range(11).select(F.col("id").alias("frequency"), F.explode(F.sequence(F.lit(0), F.lit(52), F.lit(4))).alias("recency")).withColumn("expected", F.round(P.expected_more(F.lit(1.0), F.col("frequency"), F.col("recency"), F.lit(52.0), MODEL), 6)))


def _fit(s, d):
    p = P.fit_purchases(_summary(s, d))
    return s.createDataFrame([(p.r, p.alpha, p.a, p.b)], "r double, alpha double, a double, b double")


query("fit_purchases")(_fit)
for _m, _p in {
    "bg": {"r": 0.24, "alpha": 4.4, "a": 0.8, "b": 2.5},
    "mbg": {"r": 0.5, "alpha": 6.0, "a": 0.9, "b": 1.6},
    "pareto": {"r": 0.55, "alpha": 10.6, "s": 0.6, "beta": 11.7},
    "bgbb": {"alpha": 1.2, "beta": 0.75, "gamma": 0.66, "delta": 2.8},
}.items():
    query(f"generate_{_m}")(lambda s, d, m=_m, p=_p: P.generate(s, m, 500, 52.0, p))
query("generate_log")(lambda s, d: P.generate(s, "pareto", 300, 52.0, {"r": 0.55, "alpha": 10.6, "s": 0.6, "beta": 11.7}, log=True))

# the series of the expectation, term by term
ORACLE["expected_purchases"] = """with k as (select k, lgamma(0.24 + k) - lgamma(0.24) + lgamma(2.5 + k) - lgamma(2.5) - lgamma(2.3 + k) + lgamma(2.3) - lgamma(1.0 + k) as c from range(0, 3000) r(k)),
 t as (select t, t / (4.4 + t)::double as z from range(1, 60) r(t)), f as (select t, sum(exp(c + k * ln(z))) as f from t, k group by 1)
 select t, round(2.3::double / (0.8::double - 1) * (1 - pow(4.4::double / (4.4 + t), 0.24::double) * f), 6) as n from f"""
query(
    "period_arithmetic",
    "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, cast(date_trunc('quarter', o_orderdate) as date) as quarter, datediff('month', date '1992-01-01', cast(o_orderdate as date))::int as months, datediff('day', date '1992-01-01', cast(o_orderdate as date))::int as days, cast(cast(o_orderdate as date) + interval 3 month as date) as later from orders",
)(
    lambda s, d: orders(s, d).select(
        "o_orderkey",
        F.trunc("o_orderdate", "month").alias("month"),
        F.trunc("o_orderdate", "quarter").alias("quarter"),
        ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).alias("months"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("days"),
        F.add_months(F.col("o_orderdate").cast("date"), 3).alias("later"),
    )
)
