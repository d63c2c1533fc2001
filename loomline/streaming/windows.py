"""Streams: windowed counts with late data, sessions, and removal of repeats.

Each function takes a batch or a streaming frame; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def event_stream(spark: SparkSession, path: str, glob: str, per_trigger: int = 1) -> DataFrame:
    """A file stream over Parquet files of one schema."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(path)
    # event times need a time zone: the session's
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def windowed(df: DataFrame, at: str, length: str, slide: str | None = None, late: str = "1 hour", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """(by..., start, end, n[, total]) by tumbling or sliding windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    src = df.withWatermark(at, late) if df.isStreaming else df
    return src.groupBy(w.alias("w"), *(by or [])).agg(*aggs).select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(["n", "total"] if value else ["n"]))


def sessions(df: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): activity without a pause of ``gap``; end is the last event plus the gap."""
    src = df.withWatermark(at, late) if df.isStreaming else df
    return src.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(df: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream until its input is used up and returns what came out.

    In append mode rows go to files in the shared folder, with a checkpoint
    beside them, so nothing is held on the driver. Complete mode, which files
    can't take, writes each batch's whole result and keeps the last.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, f"{name}-rows"), scratch_path(spark, f"{name}-state")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", state).queryName(name).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
