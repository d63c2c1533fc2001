"""User-defined parts: chunkers, filters, normalisers, scorers and embedders, and a registry of names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Names of parts by kind; a name is bound once unless replaced on purpose."""

    def __init__(self) -> None:
        self._parts: dict[tuple[str, str], Any] = {}

    def add(self, kind: str, name: str, part: Any, override: bool = False) -> None:
        if (kind, name) in self._parts and not override:
            raise ValueError(f"{kind} {name!r} exists")
        self._parts[kind, name] = part

    def get(self, kind: str, name: str) -> Any:
        if (kind, name) not in self._parts:
            raise KeyError(f"no {kind} {name!r}; known: {sorted(n for k, n in self._parts if k == kind)}")
        return self._parts[kind, name]


def custom_chunks(df: DataFrame, key: str, text: str, fn: Callable[[str], Iterable[tuple[int, str]]]) -> DataFrame:
    """(key, chunk_index, char_start, chunk, error): a function of the text gives (start, chunk) pairs; where it fails, the row has the error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                if t is None:
                    continue
                try:
                    out += [(k, i, a, c, None) for i, (a, c) in enumerate(fn(t))]
                except Exception as e:  # noqa: BLE001 - the user's function may raise anything
                    out.append((k, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "char_start", "chunk", "error"]).astype({"chunk_index": "Int32", "char_start": "Int32"})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_index int, char_start int, chunk string, error string")


def custom_filter(fn: Callable[[Any], bool]) -> Callable[[Column], Column]:
    """A predicate on a column; where the function fails the row is dropped."""

    @F.pandas_udf(T.BooleanType())
    def keep(s: pd.Series) -> pd.Series:
        def one(x: Any) -> bool:
            try:
                return bool(fn(x))
            except Exception:  # noqa: BLE001
                return False

        return s.map(one).astype(bool)

    return keep


def custom_normalizer(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function; null stays null."""

    @F.pandas_udf(T.StringType())
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(x) if x is not None else None)

    return norm


def custom_scores(df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[float]], top: int) -> DataFrame:
    """(key, score) of the best rows by a function of a batch of texts; ties by key."""

    @F.pandas_udf(T.DoubleType())
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(fn([x or "" for x in s]), dtype=float)

    return df.select(key, score(text).alias("score")).orderBy(F.desc("score"), key).limit(top)


def hashing_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Text to a unit vector of hashed word counts; a text without words is the zero vector. Deterministic, for tests and baselines."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        import re

        import numpy as np
        import xxhash

        def one(t: str | None) -> list[float]:
            v = np.zeros(dims, np.float32)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                v[h % dims] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return s.map(one)

    return embed


def embed_with_cache(spark: SparkSession, df: DataFrame, text: str, cache: DataFrame | None, embed: Callable[[Column], Column]) -> DataFrame:
    """(text_hash, embedding) of every distinct text: known ones come from the cache, only the others are embedded."""
    wanted = df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.first(text).alias("t"))
    if cache is None:
        return wanted.select("text_hash", embed(F.col("t")).alias("embedding"))
    new = wanted.join(cache.select("text_hash"), "text_hash", "left_anti").select("text_hash", embed(F.col("t")).alias("embedding"))
    return cache.join(wanted.select("text_hash"), "text_hash", "left_semi").select("text_hash", "embedding").unionByName(new)


def group_statistic(df: DataFrame, by: list[str], column: str, fn: Callable[[Any], float], out: str = "value") -> DataFrame:
    """(by..., out): a user's aggregate of the non-null values of each group, which it gets as one array. For functions that have no partial form; a group's values meet in one task."""

    @F.pandas_udf(T.DoubleType())
    def agg(s: pd.Series) -> float:
        x = s.dropna().to_numpy()
        return float(fn(x)) if len(x) else float("nan")

    return df.groupBy(*by).agg(agg(F.col(column).cast("double")).alias("_v")).select(*by, F.when(~F.isnan("_v"), F.col("_v")).alias(out))


#: Libraries that a back end needs, by its name.
BACKENDS = {"yake": "yake", "keybert": "keybert", "spacy": "spacy"}


def optional(backend: str, fn: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A text function that needs a library: null for every row, and a warning, where that isn't installed."""
    from importlib.util import find_spec
    from warnings import warn

    if find_spec(BACKENDS.get(backend, backend)) is None:
        warn(f"{backend} is not installed; its column is null", stacklevel=2)
        return lambda _column: F.lit(None).cast("array<string>")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(x) if x is not None else None)

    return run


class CorpusBuilder:
    """A pipeline from parts made by factories: source, then any number of filters, normalisers, chunkers and enrichers, then a sink. Each part takes and gives a frame; a part that isn't given is left out."""

    ORDER = ("filter", "normalizer", "chunker", "enricher")

    def __init__(self, source: Callable[[], DataFrame], sink: Callable[[DataFrame], Any] | None = None, **factories: Callable[[], Callable[[DataFrame], DataFrame]] | None) -> None:
        unknown = sorted(set(factories) - set(self.ORDER))
        if unknown:
            raise ValueError(f"unknown parts {unknown}; known: {list(self.ORDER)}")
        self.source, self.sink, self.factories = source, sink, factories

    def build(self) -> DataFrame:
        df = self.source()
        for name in self.ORDER:
            if self.factories.get(name):
                df = self.factories[name]()(df)
        if self.sink:
            self.sink(df)
        return df
