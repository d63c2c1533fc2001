"""Rows of documents: promoted keys, replacement, validation, citation rows, transcript choice, and a run over stages with hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promote_keys(df: DataFrame, raw: str, known: dict[str, str], rest: str = "metadata") -> DataFrame:
    """Keys of a string map as columns of their types (what can't be cast is null), the others kept in a map."""
    picked = [F.try_element_at(raw, F.lit(k)).try_cast(t).alias(k) for k, t in known.items()]
    return df.select(*[c for c in df.columns if c != raw], *picked, F.map_filter(raw, lambda k, _: ~k.isin(*known)).alias(rest))


def replace_fields(df: DataFrame, **values: Column) -> DataFrame:
    """The frame with new values of some columns; an unknown column raises."""
    unknown = sorted(set(values) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return df.withColumns(values)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break any rule, with the names of the rules they break; a rule that is null is kept."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def citations(df: DataFrame, order: list[Column], text: str, top: int, length: int) -> DataFrame:
    """(number, passage): the first rows as numbered passages of limited length."""
    cut = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(F.col(text))
    best = df.orderBy(*order).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("number"), cut.alias("passage"))


def choose_first(df: DataFrame, by: list[str], preference: list[Column]) -> DataFrame:
    """One row a group: the first in order of preference. The rows of a group combine before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)])
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("s")).select(*by, "s.*")


def run_stages(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], before: Callable[[str, DataFrame], DataFrame] | None = None, after: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Applies named stages in order, with a hook around each; a hook that fails leaves the frame as it was."""

    def hook(f, name: str, x: DataFrame) -> DataFrame:
        if f is None:
            return x
        try:
            return f(name, x) or x
        except Exception:  # noqa: BLE001 - a hook must not end the run
            return x

    for name, stage in stages:
        df = hook(after, name, stage(hook(before, name, df)))
    return df


def counts_per_million(df: DataFrame, row: str, value: str) -> DataFrame:
    """Adds cpm: a value's share of its row's total, times a million."""
    total = df.groupBy(row).agg(F.sum(value).alias("_t"))
    return df.join(total, row).withColumn("cpm", F.try_divide(1e6 * F.col(value), F.col("_t"))).drop("_t")
