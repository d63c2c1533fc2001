"""Queries on intervals, resampling, clipping and point patterns, with their checking SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import intervals as I
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


def _returns(s, d):
    returned = (F.col("l_returnflag") == "R").cast("int")
    return t(s, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"), F.sum(returned).alias("k"))


def _binomial(kind):
    def run(s, d):
        b = I.binomial_bounds(F.col("k"), F.col("n"), 0.95, kind)
        return rounded(_returns(s, d).withColumn("b", b).select("l_quantity", "n", "k", "b.low", "b.high"), "low", "high", digits=5)

    return run


_K = "with k as (select l_quantity, count(*) as n, count(*) filter (l_returnflag = 'R') as k, 1.959963984540054::double as z from lineitem group by 1)"
query(
    "binomial_wald",
    _K + """ select l_quantity, n, k, round(k / n - z * sqrt(k / n * (1 - k / n) / n), 5) as low, round(k / n + z * sqrt(k / n * (1 - k / n) / n), 5) as high from k""",
)(_binomial("wald"))
query(
    "binomial_wilson",
    _K + """ select l_quantity, n, k,
      round(greatest(0, ((k + z * z / 2) - z * sqrt(n) * sqrt(k / n * (1 - k / n) + z * z / (4 * n))) / (n + z * z)), 5) as low,
      round(least(1, ((k + z * z / 2) + z * sqrt(n) * sqrt(k / n * (1 - k / n) + z * z / (4 * n))) / (n + z * z)), 5) as high from k""",
)(_binomial("wilson"))
query("binomial_jeffreys")(_binomial("jeffreys"))
query("binomial_flat")(_binomial("flat"))


def _counts(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


def _poisson(kind, **more):
    def run(s, d):
        b = I.poisson_bounds(F.col("n"), kind, 1.0, **more)
        return rounded(_counts(s, d).withColumn("b", b).select("user_id", "n", "b.low", "b.high"), "low", "high", digits=4)

    return run


_C = "with c as (select user_id, count(*) as n from events group by 1)"
query("poisson_sherpagehrels", _C + " select user_id, n, round(n - 1 - sqrt(n + 0.75), 4)::double as low, round(n + 1 + sqrt(n + 0.75), 4)::double as high from c")(_poisson("sherpagehrels"))
query("poisson_frequentist")(_poisson("frequentist-confidence"))
query("poisson_background")(_poisson("kraft-burrows-nousek", background=2.0, level=0.9))


def _day_share(c="ts"):
    return (F.hour(c) * 60 + F.minute(c)) / F.lit(1440.0)


def _kuiper_two(s, d):
    e = t(s, d, "events")
    a, b = (F.when(F.col("event_type") == k, _day_share()) for k in ("purchase", "click"))
    return rounded(I.kuiper_two(e, a, b), "d")


_SHARE = "(extract(hour from ts) * 60 + extract(minute from ts)) / 1440.0::double"
query(
    "kuiper_two",
    f"""with x as (select {_SHARE} as x, (event_type = 'purchase')::int as a, (event_type = 'click')::int as b from events where event_type in ('purchase', 'click')),
    c as (select x, sum(a) as a, sum(b) as b from x group by 1),
    r as (select sum(a) over w / sum(a) over () - sum(b) over w / sum(b) over () as gap, sum(a) over () as n, sum(b) over () as m from c window w as (order by x))
    select round(greatest(max(gap), 0) + greatest(max(-gap), 0), 6) as d, cast(max(n) as bigint) as n, cast(max(m) as bigint) as m from r""",
)(_kuiper_two)
_TERMS = " + ".join(f"2 * (4 * {j * j} * l2 - 1) * exp(-2 * {j * j} * l2)" for j in range(1, 31))
query(
    "kuiper_probability",
    f"""with l as (select c_custkey, pow((sqrt(100.0::double) + 0.155 + 0.24 / sqrt(100.0::double)) * (c_custkey % 40) / 100.0::double, 2) as l2 from customer)
    select c_custkey, round(case when l2 < 0.16 then 1 else greatest(0, least(1, {_TERMS})) end, 6)::double as p from l""",
)(lambda s, d: t(s, d, "customer").select("c_custkey", F.round(I.kuiper_probability((F.col("c_custkey") % 40) / 100.0, F.lit(100.0)), 6).alias("p")))

_ANGLE = "(extract(hour from ts) + extract(minute from ts) / 60.0::double) * 2 * pi() / 24"


def _angle():
    return (F.hour("ts") + F.minute("ts") / F.lit(60.0)) * 2 * math.pi / 24


query(
    "v_test",
    f"""with a as (select event_type, count(*) as n, avg(cos({_ANGLE} - 1.0)) as v from events group by 1), z as (select *, v * sqrt(2 * n) as z from a),
    u as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::double)) as t from z),
    e as (select *, 0.5 * (0.254829592 * t - 0.284496736 * t**2 + 1.421413741 * t**3 - 1.453152027 * t**4 + 1.061405429 * t**5) * exp(-z * z / 2) as tail from u)
    select event_type, n, round(v, 6) as v, round(case when z >= 0 then tail else 1 - tail end + exp(-z * z / 2) / sqrt(2 * pi())
      * ((3 * z - z**3) / (16 * n) + (15 * z + 305 * z**3 - 125 * z**5 + 9 * z**7) / (4608.0 * n * n)), 4) as p from e""",
)(lambda s, d: rounded(rounded(I.v_test(t(s, d, "events"), _angle(), 1.0, ["event_type"]), "v"), "p", digits=4))
query(
    "circular_moment_3",
    f"""with x as (select event_type, {_ANGLE} as x, value as w from events where value is not null),
    m as (select event_type, atan2(sum(w * sin(x)), sum(w * cos(x))) as m from x group by 1),
    a as (select event_type, sum(w * cos(3 * (x - m))) as c, sum(w * sin(3 * (x - m))) as s, sum(w) as t from x join m using (event_type) group by 1)
    select event_type, round(atan2(s, c), 5) as angle, round(sqrt(c * c + s * s) / t, 6) as length from a""",
)(lambda s, d: rounded(rounded(I.circular_moment(t(s, d, "events"), _angle(), 3, ["event_type"], True, F.col("value")), "length"), "angle", digits=5))


def _cubed(s, d):
    return t(s, d, "orders").select("o_orderkey", F.pow(F.col("o_totalprice") / 100000, F.lit(3)).alias("x"))


_CLIP = "with c0 as (select o_orderkey, power(o_totalprice / 100000, 3) as x from orders)" + "".join(
    f", b{i} as (select median(x) - 2 * stddev_pop(x) as lo, median(x) + 2 * stddev_pop(x) as hi from c{i}), c{i + 1} as (select c.* from c{i} c, b{i} where x between lo and hi)" for i in range(5)
)
query("sigma_clip_rows", _CLIP + " select o_orderkey, not (x between lo and hi) as clipped, round(lo, 5) as clip_low, round(hi, 5) as clip_high from c0, b4")(
    lambda s, d: rounded(I.sigma_clip(_cubed(s, d), "x", 2.0), "clip_low", "clip_high", digits=5).drop("x")
)
query("bin_edges", "with s as (select min(o_totalprice) as a, max(o_totalprice) as z from orders) select list_transform(range(0, 13), lambda i: round(a + (z - a) * i / 12, 4)) as edges from s")(
    lambda s, d: I.bin_edges(t(s, d, "orders"), "o_totalprice", 12).select(F.transform("edges", lambda e: F.round(e, 4)).alias("edges"))
)
_JACK = """with s as (select c_mktsegment, count(*) as n, avg(c_acctbal) as m, var_pop(c_acctbal) as v from customer group by 1),
    l as (select c_mktsegment, n, {whole} as whole, {loo} as loo from customer join s using (c_mktsegment)),
    a as (select c_mktsegment, max(n) as n, max(whole) as whole, avg(loo) as l, var_pop(loo) as w from l group by 1),
    e as (select c_mktsegment, (n - 1) * (l - whole) as bias, whole - (n - 1) * (l - whole) as est, sqrt((n - 1) * w) as err from a)
    select c_mktsegment, round(est, 2) as estimate, round(bias, 2) as bias, round(err, 2) as std_err, round(est - 1.959963984540054 * err, 2) as low, round(est + 1.959963984540054 * err, 2) as high from e"""
_VAR = "(n * v - (c_acctbal - m)**2 * n / (n - 1)) / (n - 1)"
for _k, _whole, _loo in (("var", "v", _VAR), ("std", "sqrt(v)", f"sqrt({_VAR})")):
    query(f"jackknife_{_k}", _JACK.format(whole=_whole, loo=_loo))(lambda s, d, k=_k: rounded(I.jackknife(t(s, d, "customer"), "c_acctbal", k, ["c_mktsegment"]), "estimate", "bias", "std_err", "low", "high", digits=2))
query(
    "jackknife_samples",
    """with x as (select o_custkey, o_orderkey, o_totalprice as x, count(*) over w as n, sum(o_totalprice) over w as t from orders window w as (partition by o_custkey))
    select o_custkey, o_orderkey as left_out, n - 1 as n, round(t - x, 2) as total, round((t - x) / (n - 1), 7) as mean from x where n > 1""",
)(lambda s, d: rounded(rounded(I.jackknife_samples(t(s, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey"), "total", digits=2), "mean", digits=7))
query("bootstrap_var")(lambda s, d: I.bootstrap(t(s, d, "orders"), "o_totalprice", "o_orderkey", "var"))

_POINTS = "with p as (select c_custkey as id, (c_acctbal + 1000) / 11000 as x, (c_custkey * 7919 % 1000) / 1000.0::double as y from customer), q as (select *, least(1 - x, 1 - y, x, y) as edge from p)"
_PAIRS = _POINTS + ", d as (select sqrt((a.x - b.x)**2 + (a.y - b.y)**2) as d, a.edge, 1 / ((1 - abs(a.x - b.x)) * (1 - abs(a.y - b.y))) as w from q a join q b on a.id <> b.id and abs(a.x - b.x) < 0.05 and abs(a.y - b.y) < 0.05), r as (select unnest([0.01, 0.03, 0.05]::double[]) as radius)"
_RIPLEY = {
    "none": "(select coalesce(count(*), 0) from d where d < radius) / ((select count(*) from p) * ((select count(*) from p) - 1.0))",
    "translation": "(select coalesce(sum(w), 0) from d where d < radius) / ((select count(*) from p) * ((select count(*) from p) - 1.0))",
    "var-width": "(select coalesce(count(*), 0) from d where d < radius and edge > radius) / greatest(1, (select count(*) from q where edge > radius)) / (select count(*) from p)::double",
}
for _m, _sql in _RIPLEY.items():
    query(f"ripley_{_m.replace('-', '_')}", _PAIRS + f" select radius, round(({_sql})::double, 8) as k from r")(
        lambda s, d, m=_m: rounded(
            I.ripley(t(s, d, "customer"), "c_custkey", (F.col("c_acctbal") + 1000) / 11000, (F.col("c_custkey") * 7919 % 1000) / F.lit(1000.0), [0.01, 0.03, 0.05], (0.0, 0.0, 1.0, 1.0), m),
            "k",
            digits=8,
        )
    )
