"""Further sinks: files of one format a partition, whole-table publishing, and rows shaped for other tools."""

from __future__ import annotations

import os
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Writes a frame beside its place and then renames it there: readers see the old table or the new one, never a part. The old one is kept until the new one is complete."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.options(**options).format(fmt).save(new)
    at = fs_path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at)
    if had and not fs.rename(at, fs_path(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(fs_path(new), at):
        if had:
            fs.rename(fs_path(old), at)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(fs_path(old), True)


def _local(path: str) -> str:
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*://", path):
        raise ValueError("files of this format go to a folder that all executors can open")
    return re.sub(r"^file:(//)?", "", path)


def write_npy(df: DataFrame, path: str, key: str, vector: str) -> DataFrame:
    """Writes vectors as .npy matrices with their keys in .keys.npy beside them, a pair for each batch, to a folder that all executors share; (file, n, dims) of what was written. Vectors of different lengths raise."""
    dims = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError("vectors of different lengths")
    folder = _local(path)

    def run(batches):
        import numpy as np

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            if len(pdf):
                name = f"part-{uuid.uuid4().hex}"
                m = np.array(pdf["v"].tolist(), np.float32)
                np.save(f"{folder}/{name}.npy", m)
                np.save(f"{folder}/{name}.keys.npy", pdf["k"].to_numpy())
                yield pd.DataFrame([(f"{name}.npy", len(m), m.shape[1])], columns=["file", "n", "dims"])

    done = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(run, "file string, n long, dims int")
    return df.sparkSession.createDataFrame(done.collect(), "file string, n long, dims int")  # one row a file


def read_npy(df_files: DataFrame) -> DataFrame:
    """(key, vector) of what ``write_npy`` wrote, from the files (input_path) of its matrices."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            for p in pdf["input_path"]:
                p = _local(p)
                m, k = np.load(p, allow_pickle=False), np.load(re.sub(r"\.npy$", ".keys.npy", p), allow_pickle=False)
                yield pd.DataFrame({"key": k, "vector": m.tolist()})

    return df_files.select("input_path").mapInPandas(run, "key long, vector array<float>")


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """Writes a frame as Arrow stream files, one for each partition, as data set libraries read them; (file, n) of what was written."""
    folder = _local(path)

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        name, writer, n = f"data-{uuid.uuid4().hex}.arrow", None, 0
        for b in batches:
            if writer is None:
                writer = pa.ipc.new_stream(f"{folder}/{name}", b.schema)
            writer.write_batch(b)
            n += b.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    done = df.mapInArrow(run, "file string, n long")
    return df.sparkSession.createDataFrame(done.collect(), "file string, n long")  # one row a file


def read_arrow(df_files: DataFrame, schema: str) -> DataFrame:
    """The rows of Arrow stream files (input_path)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                with pa.ipc.open_stream(_local(p)) as r:
                    yield from r

    return df_files.select("input_path").mapInArrow(run, schema)


def page_content(df: DataFrame, text: str, *metadata: str) -> DataFrame:
    """(page_content, metadata): a text and a map of the other columns as strings, without nulls."""
    pairs = F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.col(text).alias("page_content"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("metadata"))


def passage_tuples(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(passage): one struct of id, text and attributes (as JSON) a row, the form that retrieval chains take."""
    return df.select(F.struct(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.to_json(F.struct(*more)).alias("attributes")).alias("passage"))


def tool_results(df: DataFrame, key: str, text: str, score: str, longest: int = 400) -> DataFrame:
    """(id, content, score): search results for a tool, one line of limited length each."""
    from ..functions.strings import clean_line

    return df.select(F.col(key).cast("string").alias("id"), clean_line(F.col(text), longest).alias("content"), score)


def write_single(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """Writes a small frame as one .parquet, .csv or .feather file; more rows than ``most`` raise. Returns the number of rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one file")
    write = {"parquet": rows.to_parquet, "csv": lambda p: rows.to_csv(p, index=False), "feather": rows.to_feather}
    fmt = path.rsplit(".", 1)[-1]
    if fmt not in write:
        raise ValueError(f"unknown format {fmt!r}")
    write[fmt](_local(path))
    return len(rows)


def vector_columns(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, v0, v1, ...): vectors as columns, the table form of an index; shorter vectors end in nulls."""
    return df.select(F.col(key).alias("id"), *[F.get(F.col(vector), i).alias(f"v{i}") for i in range(dims)])
