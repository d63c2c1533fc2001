"""Running parts: pipelines that may resample while they are fitted, error policies, batches of texts, and a bounded search service."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = logging.getLogger(__name__)


class ResamplingPipeline:
    """Named steps over frames. A step with ``fit`` gives a function that is applied in fitting and later on; a step with ``resample`` changes rows (features and labels together) in fitting only."""

    def __init__(self, steps: list[tuple[str, Any]]) -> None:
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError("names of steps must differ")
        self.steps = steps
        self.fitted: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def fit(self, df: DataFrame) -> DataFrame:
        """Fits the steps in order and returns the frame that the last one saw, transformed."""
        self.fitted = []
        for name, step in self.steps:
            if hasattr(step, "resample"):
                df = step.resample(df)
            else:
                f = step.fit(df)
                self.fitted.append((name, f))
                df = f(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted and any(hasattr(s, "fit") for _, s in self.steps):
            raise RuntimeError("fit the pipeline first")
        for _, f in self.fitted:
            df = f(df)
        return df


def with_policy(fn: Callable[[Any], Any], policy: str = "raise", retries: int = 0) -> Callable[[Any], Any]:
    """A function that is tried again up to ``retries`` times, and then raises, gives None (skip), or gives None and writes a log line (log)."""
    if policy not in ("raise", "skip", "log"):
        raise ValueError(f"unknown policy {policy!r}")

    def run(x: Any) -> Any:
        for k in range(retries + 1):
            try:
                return fn(x)
            except Exception as e:  # noqa: BLE001 - the user's function may raise anything
                if k < retries:
                    continue
                if policy == "raise":
                    raise
                if policy == "log":
                    _LOG.warning("skipped after %d tries: %s", retries + 1, e)
                return None

    return run


def chunk_batch(spark: SparkSession, texts: list[str], ids: list[str] | None, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks of a list of texts with their ids (their places if none are given); lists of different lengths raise."""
    if ids is not None and len(ids) != len(texts):
        raise ValueError(f"{len(texts)} texts and {len(ids)} ids")
    rows = list(zip([str(i) for i in range(len(texts))] if ids is None else ids, texts))
    return chunker(spark.createDataFrame(rows, "doc_id string, text string"))


def as_pairs(chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunks): each document's chunks as an array of (char_start, chunk) in order, the form that other chunkers' callers take. Chunks without a place have null there."""
    start = F.col("char_start") if "char_start" in chunks.columns else F.lit(None).cast("int")
    each = F.struct(F.col("chunk_index").alias("i"), start.cast("int").alias("char_start"), "chunk")
    got = chunks.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("c"))
    return got.select(key, F.transform("c", lambda x: F.struct(x["char_start"].alias("char_start"), x["chunk"].alias("chunk"))).alias("chunks"))


class SearchService:
    """A read-only search for tools: at most ``concurrent`` searches at a time, results cut to ``top`` rows. A blank query gives no rows; a search beyond the bound waits up to ``patience`` seconds and then raises."""

    def __init__(self, search: Callable[[str, int], DataFrame], concurrent: int = 4, top: int = 50, patience: float = 30.0) -> None:
        self._search, self._slots, self.top, self.patience = search, threading.BoundedSemaphore(concurrent), top, patience

    def search(self, query: str, k: int = 5) -> list[dict[str, Any]]:
        if not query.strip():
            return []
        if not self._slots.acquire(timeout=self.patience):
            raise TimeoutError("too many searches at a time")
        try:
            return [r.asDict(True) for r in self._search(query.strip(), max(1, min(k, self.top))).collect()]
        finally:
            self._slots.release()
