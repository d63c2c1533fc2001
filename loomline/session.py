"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "loomline") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Tables written for later steps, and temporary folders of sessions in one process.
_WRITTEN: list[str] = []
_OWN: list[str] = []
#: Spark's setting by which a query's shuffle files are removed at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares between executors.

    The folder is ``spark.checkpoint.dir``; only a session without that
    setting that runs in one process (tests) gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
        _OWN.append(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomline-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor costs nothing.

    What is written is deleted at the end of the program, or of the ``scratch`` block around it.
    The shuffle files of the write go as soon as it is done, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _WRITTEN.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote, when nothing reads it any more."""
    names = {f.split("/")[-2] for f in df.inputFiles()}
    gone = [p for p in _WRITTEN if p.rsplit("/", 1)[1] in names]
    _WRITTEN[:] = [p for p in _WRITTEN if p not in gone]
    _delete(df.sparkSession, gone)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block at whose end all tables that were written inside it are deleted. Results must be stored or collected before."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        done = _WRITTEN[first:]
        del _WRITTEN[first:]
        _delete(spark, done)


@atexit.register
def _tidy() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        try:
            _delete(spark, _WRITTEN)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    # without a session only local paths can be reached
    for p in [*_WRITTEN, *_OWN]:
        if p.startswith("file:"):
            shutil.rmtree(p.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table of few files would leave most of them idle; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
