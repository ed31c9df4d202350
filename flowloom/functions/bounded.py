"""Guards that keep driver-side and broadcast data within a checked bound."""

from __future__ import annotations

import functools
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
#: Spark's setting that lets a finished job's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Frames and folders that `stabilise` has made in the innermost `scratch`.
_made: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("made", default=None)


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS):
    """Evaluate `df` once if it is small.

    At most `max_rows + 1` rows travel to the driver. Returns `(frame, rows)`: a
    broadcast-hinted local table and its rows when the bound holds, otherwise the
    untouched frame and `None`, so that joins fall back to a shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names; a temporary one only where all executors are this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_dir()


def stabilise(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and read it back.

    Used where a later step needs the very same rows twice (for instance row
    positions taken from a range shuffle). The written table survives the loss
    of executors and cuts the lineage, so the shuffle files of the job that wrote it are not kept.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append((stored, path))
    return stored


@contextmanager
def scratch(spark: SparkSession):
    """Folders that `stabilise` makes inside are deleted at the end, but for those of the frames given to the yielded function.

    Nothing else that reads them may be used afterwards.
    """
    own: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []

    def keep(stored: DataFrame) -> DataFrame:
        kept.append(stored)
        return stored

    token = _made.set(own)
    try:
        yield keep
    finally:
        _made.reset(token)
        outer = _made.get()
        for frame, path in own:
            if not any(frame is k for k in kept):
                _delete(spark, path)
            elif outer is not None:
                outer.append((frame, path))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(stored: DataFrame) -> None:
    """The folder of a frame that `stabilise` made in the innermost `scratch` is deleted before its end; other frames are left."""
    made = _made.get() or []
    for entry in [e for e in made if e[0] is stored]:
        made.remove(entry)
        _delete(stored.sparkSession, entry[1])
