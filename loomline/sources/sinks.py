"""Exports of document frames and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import load_data

IDENTITY = ("doc_id", "input_path", "chunk_index", "text")


def flatten_metadata(df: DataFrame, column: str = "metadata", most: int = 500) -> DataFrame:
    """A map column as columns of its own: identity columns first, the others in order. More than ``most`` keys raise; null maps give nulls."""
    rest = [c for c in df.columns if c != column]
    if column not in df.columns:
        keys: list[str] = []
    else:
        got = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} keys in {column}")
        keys = sorted(r.k for r in got if r.k not in rest)
    first = [c for c in IDENTITY if c in rest]
    other = sorted([*(c for c in rest if c not in first), *keys])
    return df.select(*first, *[F.try_element_at(column, F.lit(c)).alias(c) if c in keys else F.col(c) for c in other])


def export_documents(df: DataFrame, path: str, fmt: str = "parquet", embedding: str | None = "embedding", compression: str = "zstd") -> None:
    """Writes a frame as parquet, csv, jsonl, json (one array a partition file) or orc; a table that is there is replaced, and while that goes on it is gone (``exports.publish`` keeps it until the new one is complete). CSV never has embeddings."""
    if fmt == "csv":
        flat = flatten_metadata(df.drop(embedding) if embedding else df)
        flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "json":
        df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(_arrays, "value string").write.mode("overwrite").text(path)
    elif fmt in ("parquet", "orc"):
        df.write.mode("overwrite").option("compression", compression).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def _arrays(batches):
    """JSON array lines, one for each batch of rows."""
    import pandas as pd

    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"value": ["[" + ", ".join(pdf["value"]) + "]"]})


def load_documents(spark: SparkSession, path: str, fmt: str, sha256: dict[str, str] | None = None, **options) -> DataFrame:
    """Reads an export; with ``sha256`` (file name to digest) every file is checked first."""
    if sha256:
        seen = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("h"))
        want = spark.createDataFrame(list(sha256.items()), "name string, want string")
        bad = want.join(seen, "name", "left").where("h is null or h <> want").limit(5).collect()
        if bad:
            raise ValueError(f"digest differs: {[r.name for r in bad]}")
    return load_data(spark, path, f".{fmt}", **options)


def save_vectors(df: DataFrame, path: str, key: str, vector: str) -> int:
    """Writes vectors as a table of npy bytes, one row for each partition, with their keys beside them, to any file system (``exports.write_npy`` writes plain .npy files); mixed dimensions raise. Returns the dimension."""
    dims = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError("vectors of different dimensions")

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        keys, rows = [], []
        for pdf in batches:
            keys += pdf[key].tolist()
            rows += pdf[vector].tolist()
        if rows:
            b = io.BytesIO()
            np.save(b, np.array([np.asarray(r, np.float32) for r in rows]))
            yield pd.DataFrame({"keys": [keys], "npy": [b.getvalue()]})

    kind = df.schema[key].dataType.simpleString()
    df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"keys array<{kind}>, npy binary").write.mode("overwrite").parquet(path)
    return dims[0].d if dims else 0
