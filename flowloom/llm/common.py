"""What the operators of this subpackage share: tables, Arrow helpers, hashes and id filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of an id filter. It travels to every task, so its size is fixed; with more ids than fit it only lets more rows pass.
FILTER_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes; of the whole sequence when it is shorter; none of an empty one."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `size` bytes, for functions that hold many times their input."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """Jobs that run inside hand Python so many rows at once: for tables whose rows are large. The session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType,
              slice_bytes: int | None = None) -> DataFrame:
    """Apply a function of one Arrow batch to every batch; batches it returns None for are left out.

    With `slice_bytes` a batch is handed on in slices of about this size, for functions that hold many times their input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, slice_bytes) if slice_bytes else batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def binary(rows: np.ndarray) -> pa.Array:
    """A matrix's rows as binary cells."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix(cells: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary cells of equal length as a matrix."""
    return np.frombuffer(b"".join(cells.to_pylist()), dtype).reshape(len(cells), width)


def slots(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)


def id_filter(ids: DataFrame, column: str):
    """A broadcast bitmap that is set at least for every id of `ids`; bounded by FILTER_BITS whatever their number."""

    def fold(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[slots(batch.column(0).to_numpy(zero_copy_only=False))] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at])], ["at", "word"])

    partial = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(fold, "at long, word long")
    rows = partial.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER_BITS / 64 rows at most
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(words.view(np.uint8))  # eight ids a byte: every filter leaves a file of its size on each machine


def may_contain(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at = slots(ids.fill_null(0).to_numpy(zero_copy_only=False))
    return known & ((bits[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & np.uint8(128)) != 0)
