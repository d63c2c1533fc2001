"""Ordered analytics without a global sort in one task.

A running total over a whole table is taken in two steps: rows are range
partitioned by the order key, partition totals are summed up in order (one row
a partition), and each partition adds its offset to its own running total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running_total(df: DataFrame, order: list[Column], totals: dict[str, str], grand: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds running totals over the whole table, or within each group of ``by``.

    ``totals`` maps new columns to the summed ones; ``grand`` maps new columns to
    the summed ones whose overall sum is wanted. The order must be total up to rows that may share a result.
    Null values count as nothing. An empty table stays empty. Rows are range
    partitioned by group and order, so one group of any size spreads over tasks.
    """
    grand, by = grand or {}, by or []
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # range borders are sampled; writing the result fixes each row's partition for good
    laid = materialise(df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id()), "ordered")
    sums = laid.groupBy("_p", *by).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()], *[F.sum(c).alias(f"_g_{n}") for n, c in grand.items()])
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = (Window.partitionBy(*by) if by else Window).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition and group
    offsets = sums.select("_p", *by, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals], *[F.sum(f"_g_{n}").over(every).alias(n) for n in grand])
    own = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = laid.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_r_{n}") for n, c in totals.items()])
    if by:
        # groups may be as many as rows; a null is a group too
        same = F.col("a._p") == F.col("b._p")
        for c in by:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        got = got.alias("a").join(offsets.alias("b"), same).select("a.*", *[f"b._o_{n}" for n in totals], *[f"b.{n}" for n in grand])
    else:
        got = got.join(F.broadcast(offsets), "_p")
    return got.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals], *grand)


def with_previous(df: DataFrame, order: list[Column], columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the value of the row before: new column -> (column, value at the first row).

    The partition borders are bridged by each partition's last row.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = materialise(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ordered")
    own = Window.partitionBy("_p").orderBy(*order)
    ranked = laid.withColumn("_n", F.row_number().over(own))
    tail = ranked.groupBy("_p").agg(F.max_by(F.struct(*sorted({c for c, _ in columns.values()})), "_n").alias("_t"))
    last = tail.select("_p", F.lag("_t").over(Window.orderBy("_p")).alias("_b"))
    got = ranked.select("*", *[F.lag(c).over(own).alias(f"_l_{n}") for n, (c, _) in columns.items()]).join(F.broadcast(last), "_p")
    pick = [F.coalesce(F.when(F.col("_n") > 1, F.col(f"_l_{n}")).otherwise(F.col(f"_b.{c}")), F.lit(d)).alias(n) for n, (c, d) in columns.items()]
    return got.select(*df.columns, *pick)


def quantiles(df: DataFrame, column: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row a group (one row in all without ``by``).

    Values are counted first, so the work is on distinct values; nulls and NaN
    are left out. A group without values, and an empty table, gives no row.
    """
    by = by or []
    x = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*by, F.col(column).cast("double").alias("_x"))
    counted = x.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    seq = running_total(counted, [F.col("_x")], {"_hi": "_c"}, {"_n": "_c"}, by)
    seq = seq.withColumn("_lo", F.col("_hi") - F.col("_c"))
    out = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        inside = lambda k: F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col("_x")))  # noqa: E731, B023
        frac = F.max(at - low)
        out.append((inside(low) + (inside(high) - inside(low)) * frac).alias(name))
    return seq.groupBy(*by).agg(*out)
