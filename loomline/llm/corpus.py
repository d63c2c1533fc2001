"""Access to the corpus tables shared by the operators of this package.

A corpus row is one saved state of a chunk; the current record of a doc_id is
the state with the latest stored_at. Operators that give a small verdict for
each text compute it for every state, next to the scan, and keep the verdict of
the latest state: fixed-width verdicts are shuffled, texts are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread

JSON_FIELDS = "text string, source_title string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str, *columns: str, title: bool = False) -> DataFrame:
    """All states with doc_id, stored_at, the text and the given columns; the text of a broken json_data is null."""
    fields = JSON_FIELDS if title else "text string"
    df = spread(table(spark, sf_dir, "corpus_documents").select("doc_id", "stored_at", *columns, "json_data"))
    j = F.from_json("json_data", fields)
    picked = [j["text"].alias("text")] + ([j["source_title"].alias("source_title")] if title else [])
    return df.select("doc_id", "stored_at", *columns, *picked)


def latest(df: DataFrame, value: str, key: str = "doc_id", at: str = "stored_at") -> DataFrame:
    """The ``value`` of the latest state of each key; ties are identical states. Fixed-width values keep this a hash aggregate with map-side combine."""
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def current(df: DataFrame, key: str = "doc_id", at: str = "stored_at") -> DataFrame:
    """One whole row for each key: its latest state."""
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("s"))
    return got.select(key, "s.*")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def of_latest(spark: SparkSession, sf_dir: str, rows: DataFrame, *unique: str) -> DataFrame:
    """Those of the rows (with doc_id and stored_at, made from any state) that come from the latest state of their doc_id, each once by ``unique``.

    The latest states are found on two narrow columns, so only the rows given are shuffled, not the texts they come from.
    """
    last = table(spark, sf_dir, "corpus_documents").groupBy("doc_id").agg(F.max("stored_at").alias("stored_at"))
    return rows.join(last, ["doc_id", "stored_at"]).dropDuplicates(list(unique))


#: Files that a sample is drawn from, at most.
SAMPLE_FILES = 64


def few_files(df: DataFrame) -> DataFrame:
    """A table read from files, or the part of it in at most SAMPLE_FILES of them, chosen by a hash of their names."""
    files = df.inputFiles()
    if len(files) <= SAMPLE_FILES:
        return df
    files = sorted(files, key=lambda f: sha1(f.rsplit("/", 1)[-1].encode()).digest())[:SAMPLE_FILES]
    return df.sparkSession.read.schema(df.schema).parquet(*files)


#: Characters that a worker handles at once, about.
CHUNK_CHARS = 1 << 18
#: Counts that a worker holds before it passes them on.
HELD = 1 << 21


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``limit`` characters each; a longer text is a range of its own."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > limit:
            yield a, i
            a, n = i, 0
        n += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


class Tally:
    """Counts of whole numbers, summed in a worker process before they are shuffled."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size > HELD:
            self._sum()

    def _sum(self) -> None:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.zeros(len(k), np.int64)
        np.add.at(n, at, np.concatenate(self.counts))
        self.keys, self.counts, self.size = [k], [n], len(k)

    def full(self) -> bool:
        """Whether there are too many different numbers to hold on to."""
        return self.size > HELD // 2 and len(self.keys) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and their counts so far; counting starts again."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._sum()
        k, n = self.keys[0], self.counts[0]
        self.__init__()
        return k, n


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def language_label(label: Column, codes: dict[str, str]) -> Column:
    """The iso_code that a label names, or null. ``codes`` has lower-case names of languages."""
    low = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    isos = F.array(*[F.lit(x) for x in sorted(set(codes.values()))])
    head = F.regexp_extract(low, r"^([a-z]+)[-_]", 1)
    return F.coalesce(F.try_element_at(known, low), F.when(F.array_contains(isos, head), head))


def language_names(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Every name of a language in lower case, with its iso_code; language_codes is a fixed table."""
    rows = table(spark, sf_dir, "language_codes").select("iso_code", "iso3_code", "english_name").collect()
    return {str(n).lower(): r.iso_code for r in rows for n in (r.iso_code, r.iso3_code, r.english_name) if n}


def rank_within(df: DataFrame, by: list[str], order: list[str], rows: int, out: str = "rank") -> DataFrame:
    """Numbers the rows of each group from 0, without ever sorting a group in one task.

    Rows fall into hash buckets of the order columns; buckets are counted, their
    counts summed up in bucket order, and rows are numbered inside their bucket.
    The order is thereby a seeded one: by bucket, then by hash, then by the columns.
    """
    buckets = min(4096, max(8, rows // 50_000))
    h = df.withColumn("_h", F.xxhash64(*[F.col(c).cast("string") for c in order])).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *order))
    return h.withColumn("_r", inside).join(offsets, [*by, "_b"]).withColumn(out, F.col("_o") + F.col("_r") - 1).drop("_h", "_b", "_r", "_o")
