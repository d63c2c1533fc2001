"""Queries on array kernels, with their checking SQL: vectors are the quantities of an order, and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from .evaluation import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def lists(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("a"), F.array_sort(F.collect_list("l_discount")).alias("b")).select("l_orderkey", F.transform("a", lambda x: x).alias("a"), "b")


_L = "with x as (select l_orderkey, list_sort(list(l_quantity)) as a, list_sort(list(l_discount)) as b from lineitem group by 1)"


def r(c, n=6):
    return F.round(c, n)


query(
    "array_reductions",
    _L + " select l_orderkey, list_sum(a) as total, round(list_avg(a), 6) as mean, round(list_var_pop(a), 6) as var, round(list_stddev_pop(a), 6) as sd, list_min(a) as lo, list_max(a) as hi, list_max(a) - list_min(a) as ptp, round(list_median(a), 6) as med, round(quantile_q, 6) as p90, round(sqrt(list_dot_product(a, a)), 6) as norm, round(sqrt(list_dot_product(a, a) / len(a)), 6) as rms, len(list_filter(b, lambda v: v <> 0))::int as nonzero from (select *, (select quantile_cont(v, 0.9) from (select unnest(a) as v)) as quantile_q from x)",
)(lambda s, d: lists(s, d).select("l_orderkey", A.total(F.col("a")).alias("total"), r(A.mean(F.col("a"))).alias("mean"), r(A.var(F.col("a"))).alias("var"), r(A.stdev(F.col("a"))).alias("sd"), A.amin(F.col("a")).alias("lo"), A.amax(F.col("a")).alias("hi"), A.ptp(F.col("a")).alias("ptp"), r(A.median(F.col("a"))).alias("med"), r(A.percentile(F.col("a"), 90.0)).alias("p90"), r(A.norm(F.col("a"))).alias("norm"), r(A.rms(F.col("a"))).alias("rms"), A.count_nonzero(F.col("b")).alias("nonzero")))
query(
    "array_running",
    _L + " select l_orderkey, list_transform(range(1, len(a) + 1), lambda i: list_sum(a[1:i])) as cs, list_transform(range(1, len(a)), lambda i: a[i + 1] - a[i]) as df, round(list_sum(a) - (a[1] + a[len(a)]) / 2, 6) as area from x",
)(lambda s, d: lists(s, d).select("l_orderkey", A.cumsum(F.col("a")).alias("cs"), A.diff(F.col("a")).alias("df"), r(A.trapz(F.col("a"))).alias("area")))
query(
    "array_sets",
    _L + " select l_orderkey, list_sort(list_distinct(a)) as u, list_sort(list_intersect(list_distinct(a), [1.0, 5.0, 10.0, 20.0]::double[])) as i, list_sort(list_filter(list_distinct(a), lambda v: v not in (1.0, 5.0))) as e, list_reverse(a) as f, (list_position(a, list_max(a)) - 1)::bigint as am from x",
)(lambda s, d: lists(s, d).select("l_orderkey", A.unique(F.col("a")).alias("u"), A.intersect1d(F.col("a"), F.array(*[F.lit(v) for v in (1.0, 5.0, 10.0, 20.0)])).alias("i"), A.setdiff1d(F.col("a"), F.array(F.lit(1.0), F.lit(5.0))).alias("e"), A.flip(F.col("a")).alias("f"), A.argmax(F.col("a")).alias("am")))
query(
    "array_pairs",
    _L + " select l_orderkey, round(list_dot_product(a, b), 6) as dot, list_transform(a, lambda v: least(greatest(v, 5.0), 20.0)::double) as cl, round(list_sum(list_transform(a, lambda v: ln(1 + v))), 6) as lg, round(list_sum(list_transform(a, lambda v: sqrt(v))), 6) as sq from x",
)(lambda s, d: lists(s, d).select("l_orderkey", r(A.dot(F.col("a"), F.col("b"))).alias("dot"), A.clip(F.col("a"), 5.0, 20.0).alias("cl"), r(A.total(A.apply(F.col("a"), "log1p"))).alias("lg"), r(A.total(A.apply(F.col("a"), "sqrt"))).alias("sq")))
query("array_gcd_lcm", "select o_orderkey, gcd(o_orderkey, o_custkey) as g, lcm(o_orderkey, o_custkey) as l from orders where o_orderkey > 0 and o_custkey > 0")(lambda s, d: t(s, d, "orders").where("o_orderkey > 0 and o_custkey > 0").select("o_orderkey", A.gcd(F.col("o_orderkey"), F.col("o_custkey")).alias("g"), A.lcm(F.col("o_orderkey"), F.col("o_custkey")).alias("l")))
query("array_interp", "select c_custkey, round(case when c_acctbal <= 0 then 0 when c_acctbal >= 8000 then 10 when c_acctbal <= 2000 then c_acctbal / 2000 * 4 else 4 + (c_acctbal - 2000) / 6000 * 6 end, 6)::double as y from customer")(lambda s, d: t(s, d, "customer").select("c_custkey", r(A.interp(F.col("c_acctbal"), F.array(*[F.lit(v) for v in (0.0, 2000.0, 8000.0)]), F.array(*[F.lit(v) for v in (0.0, 4.0, 10.0)]))).alias("y")))
query("array_polyval", "select c_custkey, round(1 + 2 * c_nationkey + 3 * c_nationkey * c_nationkey, 6)::double as y from customer")(lambda s, d: t(s, d, "customer").select("c_custkey", A.polyval(F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0)]), F.col("c_nationkey")).alias("y")))


# every further kernel, on arrays of values that are no integers alone: v = quantity / 50 in (0, 1], b = discounts
_V = "with x as (select l_orderkey, list_transform(list_sort(list(l_quantity)), lambda q: q / 50.0::double) as v, list_sort(list(l_discount)) as b, list(l_linenumber::bigint order by l_linenumber) as k from lineitem group by 1)"


def values(s, d):
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("a"), F.array_sort(F.collect_list("l_discount")).alias("b"), F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("k"))
    return x.select("l_orderkey", F.transform("a", lambda q: q / 50.0).alias("v"), "b", "k")


#: Scalar functions in SQL, by name.
_SQL = {
    "abs": "abs({x})", "ceil": "ceil({x})", "floor": "floor({x})", "rint": "round_even({x}, 0)", "trunc": "trunc({x})", "sign": "sign({x})", "sqrt": "sqrt({x})", "cbrt": "cbrt({x})", "square": "{x} * {x}", "cube": "{x} * {x} * {x}",
    "reciprocal": "1 / {x}", "negative": "-{x}", "exp": "exp({x})", "exp2": "pow(2.0::double, {x})", "expm1": "exp({x}) - 1", "log": "ln({x})", "log2": "log2({x})", "log10": "log10({x})", "log1p": "ln(1 + {x})", "sin": "sin({x})",
    "cos": "cos({x})", "tan": "tan({x})", "arcsin": "asin({x})", "arccos": "acos({x})", "arctan": "atan({x})", "sinh": "sinh({x})", "cosh": "cosh({x})", "tanh": "tanh({x})", "arcsinh": "asinh({x})", "deg2rad": "radians({x})", "rad2deg": "degrees({x})",
    "sinc": "case when {x} = 0 then 1 else sin({x} * pi()) / ({x} * pi()) end", "sigmoid": "1 / (1 + exp(-{x}))", "wrap": "{x} - 2 * pi() * floor(({x} + pi()) / (2 * pi()))",
}
query("array_elementwise", _V + " select l_orderkey, " + ", ".join(f"round(list_sum(list_transform(v, lambda z: ({q.format(x='z')})::double)), 6) as f_{n}" for n, q in _SQL.items()) + " from x")(
    lambda s, d: values(s, d).select("l_orderkey", *[r(A.total(A.apply(F.col("v"), n))).alias(f"f_{n}") for n in _SQL])
)
query("array_hyperbolic", _V + " select l_orderkey, round(list_sum(list_transform(v, lambda z: acosh(z + 1))), 6) as f_arccosh, round(list_sum(list_transform(v, lambda z: atanh(z / 2))), 6) as f_arctanh, len(v) as f_finite from x")(
    lambda s, d: values(s, d).select(
        "l_orderkey",
        r(A.total(A.apply(F.transform("v", lambda z: z + 1), "arccosh"))).alias("f_arccosh"),
        r(A.total(A.apply(F.transform("v", lambda z: z / 2), "arctanh"))).alias("f_arctanh"),
        F.size(F.filter(F.zip_with(A.apply(F.col("v"), "isnan"), A.apply(F.col("v"), "isinf"), lambda p, q: ~p & ~q), lambda z: z)).cast("bigint").alias("f_finite"),
    )
)
query(
    "array_places",
    _V
    + """ select l_orderkey, list_position(b, list_max(b)) - 1 as amax, list_position(b, list_min(b)) - 1 as amin, len(list_filter(b, lambda z: z <> 0)) as nz, len(list_filter(b, lambda z: z = 0)) = 0 as al, len(list_filter(b, lambda z: z <> 0)) > 0 as an, len(list_filter(b, lambda z: z <> 0)) = 0 as no,
    list_reverse(v) as flip, len(list_filter(v, lambda z: z < 0.5)) as ss, list_transform(v, lambda z: len(list_filter([0.2, 0.4, 0.8]::double[], lambda e: e <= z))) as dig, list_transform(range(1, 8), lambda i: len(list_filter(k, lambda z: z = i))) as cnt,
    list_concat(v, v) as tiled, list_concat(list_concat([0.0, 0.0]::double[], v), [0.0, 0.0]::double[]) as padded, [v[1], v[2]] as took from x""",
)(
    lambda s, d: values(s, d).select(
        "l_orderkey",
        A.argmax(F.col("b")).cast("int").alias("amax"),
        A.argmin(F.col("b")).cast("int").alias("amin"),
        A.count_nonzero(F.col("b")).cast("bigint").alias("nz"),
        A.all_true(F.col("b")).alias("al"),
        A.any_true(F.col("b")).alias("an"),
        A.none_true(F.col("b")).alias("no"),
        A.flip(F.col("v")).alias("flip"),
        A.searchsorted(F.col("v"), F.lit(0.5)).cast("bigint").alias("ss"),
        F.transform(A.digitize(F.col("v"), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.8))), lambda z: z.cast("bigint")).alias("dig"),
        F.transform(F.slice(A.bincount(F.col("k"), 8), 2, 7), lambda z: z.cast("bigint")).alias("cnt"),
        A.tile(F.col("v"), 2).alias("tiled"),
        A.pad(F.col("v"), 2).alias("padded"),
        A.take(F.col("v"), [0, 1]).alias("took"),
    )
)
query(
    "array_more",
    _V
    + """ select l_orderkey, round(list_product(v), 8) as p, round(sqrt(list_avg(list_transform(v, lambda z: z * z))), 6) as rms, round(sqrt(list_sum(list_transform(v, lambda z: z * z))), 6) as nrm, round(quantile_cont(u, 0.3), 6) as q30, round(median(u), 6) as med,
    list_transform(range(1, len(v) + 1), lambda i: round(list_product(v[1:i]), 6)) as cp, list_sort(list_distinct(list_concat(v, b))) as un, list_sort(list_filter(list_distinct(b), lambda z: len(list_filter(b, lambda y: y = z)) > 1)) as dup,
    list_transform(v, lambda z: round(z / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) as unit from x, (select l_orderkey as o, unnest(v) as u from x) where o = l_orderkey group by l_orderkey, v, b""",
)(
    lambda s, d: values(s, d).select(
        "l_orderkey",
        r(A.prod(F.col("v")), 8).alias("p"),
        r(A.rms(F.col("v"))).alias("rms"),
        r(A.norm(F.col("v"))).alias("nrm"),
        r(A.percentile(F.col("v"), 30.0)).alias("q30"),
        r(A.median(F.col("v"))).alias("med"),
        F.transform(A.cumprod(F.col("v")), lambda z: F.round(z, 6)).alias("cp"),
        A.union1d(F.col("v"), F.col("b")).alias("un"),
        A.find_duplicates(F.col("b")).alias("dup"),
        F.transform(A.normalize(F.col("v")), lambda z: F.round(z, 6)).alias("unit"),
    )
)
query(
    "array_two",
    _V
    + """ select l_orderkey, round(list_sum(list_transform(list_zip(v, b), lambda z: sqrt(z[1]**2 + z[2]**2))), 6) as hyp, round(list_sum(list_transform(list_zip(v, b), lambda z: greatest(z[1], z[2]))), 6) as hi, round(list_sum(list_transform(list_zip(v, b), lambda z: least(z[1], z[2]))), 6) as lo,
    round(list_sum(list_transform(list_zip(v, b), lambda z: ln(exp(z[1]) + exp(z[2])))), 6) as lae, len(v) > 0 as same, round(list_avg(list_transform(list_zip(v, b), lambda z: z[1] * z[2])) - list_avg(v) * list_avg(b), 9) as cv from x""",
)(
    lambda s, d: values(s, d).select(
        "l_orderkey",
        r(A.total(A.hypot(F.col("v"), F.col("b")))).alias("hyp"),
        r(A.total(A.maximum(F.col("v"), F.col("b")))).alias("hi"),
        r(A.total(A.minimum(F.col("v"), F.col("b")))).alias("lo"),
        r(A.total(A.logaddexp(F.col("v"), F.col("b")))).alias("lae"),
        A.allclose(F.col("v"), F.transform("v", lambda z: z + 1e-9)).alias("same"),
        r(A.cov(F.col("v"), F.col("b")), 9).alias("cv"),
    )
)
query(
    "array_missing",
    "with x as (select l_orderkey, list(case when l_linenumber = 2 then null else l_quantity end) as a from lineitem group by 1) select l_orderkey, coalesce(list_sum(list_filter(a, lambda z: z is not null)), 0.0::double) as s, round(list_avg(list_filter(a, lambda z: z is not null)), 6) as m from x where len(list_filter(a, lambda z: z is not null)) > 0",
)(
    lambda s, d: t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_quantity"))).alias("a")).select("l_orderkey", A.nansum(F.col("a")).alias("s"), r(A.nanmean(F.col("a"))).alias("m"), F.size(A.present(F.col("a"))).alias("n")).where("n > 0").drop("n")
)
query("array_matrix", "select n_nationkey, [n_nationkey * 1.0::double, n_regionkey * 2.0 + n_nationkey]::double[] as mv, [-2.0 * n_regionkey, 0.0, n_nationkey * n_regionkey * 0.0 + 2.0 * n_nationkey - 0.0]::double[] as cr from nation")(
    lambda s, d: t(s, d, "nation").select(
        "n_nationkey",
        A.matmul(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"))).alias("mv"),
        A.cross(F.array(F.col("n_nationkey").cast("double"), F.lit(0.0), F.col("n_regionkey").cast("double")), F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0))).alias("cr"),
    )
)
query("array_makers", "select n_nationkey, list_transform(range(5), lambda i: 1.0::double + i * 0.5) as lin, list_transform(range(4), lambda i: round(pow(10.0::double, i), 4)) as geo, list_transform(range(9), lambda i: round(0.54 - 0.46 * cos(2 * pi() * i / 8), 6)) as ham, list_transform(range(9), lambda i: round(1 - abs(2.0 * i / 8 - 1), 6)::double) as bart from nation")(
    lambda s, d: t(s, d, "nation").select("n_nationkey", A.linspace(1.0, 3.0, 5).alias("lin"), F.transform(A.geomspace(1.0, 1000.0, 4), lambda z: F.round(z, 4)).alias("geo"), F.transform(A.window("hamming", 9), lambda z: F.round(z, 6)).alias("ham"), F.transform(A.window("bartlett", 9), lambda z: F.round(z, 6)).alias("bart"))
)
