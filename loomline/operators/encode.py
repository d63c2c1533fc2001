"""Encoders and imputers: what is fitted is a small table, what is applied an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles, running_total

#: Categories beyond which an encoder refuses, as its columns would not fit a row.
MOST = 2000


def parts(column: str, separator: str = ",") -> Column:
    """The distinct labels of a multi-label string: split, stripped, in lower case; null and blanks have none."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(F.split(F.col(column), separator), lambda x: F.lower(F.trim(x))), lambda x: x != "")), F.array().cast("array<string>"))


def categories(df: DataFrame, column: str, separator: str = ",", min_frequency: int = 1, max_categories: int | None = None) -> tuple[list[str], list[str]]:
    """(kept, infrequent) labels in order; those seen in fewer rows than ``min_frequency``, or beyond the most frequent ``max_categories``, are infrequent. More than MOST labels raise."""
    c = df.select(F.explode(parts(column, separator)).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(MOST + 1).collect()
    if len(c) > MOST:
        raise ValueError(f"{column} has more than {MOST} labels")
    ok = [r.c for r in c if r.n >= min_frequency]
    if max_categories is not None:
        ok = ok[:max_categories]
    return sorted(ok), sorted(r.c for r in c if r.c not in set(ok))


def dummies(df: DataFrame, column: str, kept: list[str], infrequent: list[str] | None = None, separator: str = ",", prefix: str | None = None) -> DataFrame:
    """Replaces a multi-label column by 0/1 columns, and one for infrequent labels if there are any. Unknown labels are ignored; null gives zeros."""
    p = prefix or column[:2]
    x = df.withColumn("_t", parts(column, separator))
    cols = [F.array_contains("_t", k).cast("int").alias(f"{p}_{k}") for k in kept]
    if infrequent:
        cols.append(F.arrays_overlap("_t", F.array(*[F.lit(k) for k in infrequent])).cast("int").alias(f"{p}_infrequent"))
    return x.select(*[c for c in df.columns if c != column], *cols)


def undo_dummies(df: DataFrame, prefix: str, kept: list[str], out: str) -> DataFrame:
    """The labels of 0/1 columns joined by commas; none give null."""
    labels = F.filter(F.array(*[F.when(F.col(f"{prefix}_{k}") == 1, F.lit(k)) for k in kept]), lambda x: x.isNotNull())
    return df.withColumn(out, F.nullif(F.array_join(labels, ","), F.lit("")))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the number of a value among the sorted distinct ones, from 0; null stays null. The numbering is made on the distinct values."""
    kinds = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_k")).distinct().withColumn("_one", F.lit(1))
    codes = running_total(kinds, [F.asc("_k")], {"_code": "_one"}).select("_k", (F.col("_code") - 1).cast("int").alias(out))
    return df.join(codes, df[column] == codes["_k"], "left").drop("_k")


def missing_indicator(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds c_missing (0/1) for each column; NaN is missing."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    return df.select("*", *[gone(c).cast("int").alias(f"{c}_missing") for c in columns])


def impute(df: DataFrame, column: str, strategy: str = "mean", value: object = None) -> DataFrame:
    """Fills missing values (null or NaN) with the mean, exact median, most frequent value (the least on ties) or a constant. A column without values stays null."""
    kind = dict(df.dtypes)[column]
    seen = F.when(~F.isnan(column), F.col(column)) if kind in ("double", "float") else F.col(column)
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(seen, F.lit(value).cast(kind)))
    x = df.select(seen.alias("_x")).where("_x is not null")
    if strategy == "mean":
        fill = x.agg(F.avg("_x").alias("_f"))
    elif strategy == "median":
        q = quantiles(x, "_x", {"_f": 0.5})
        fill = df.sparkSession.range(1).select().join(q, how="left")
    else:
        top = x.groupBy("_x").agg(F.count("*").alias("n")).agg(F.max(F.struct("n")).alias("m"))
        fill = x.groupBy("_x").agg(F.count("*").alias("n")).join(F.broadcast(top), F.col("n") == F.col("m.n")).agg(F.min("_x").alias("_f"))
    return df.join(F.broadcast(fill)).withColumn(column, F.coalesce(seen, F.col("_f"))).drop("_f")  # one row


def unknown_labels(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Distinct labels that a table of known ones lacks."""
    return df.select(F.col(column).alias("label")).where("label is not null").distinct().join(known.select(F.col(known_column).alias("label")), "label", "left_anti")


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n, code): distinct values with counts, numbered in order, null last."""
    c = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    return running_total(c, [F.col("value").asc_nulls_last()], {"code": "_one"}).select("value", "n", (F.col("code") - 1).cast("int").alias("code"))
