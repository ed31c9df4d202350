"""Running totals over a table, or over each of its groups, without one task sorting a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bounded import pin_small, stabilise

_WIDE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def with_running_totals(df: DataFrame, by: str, totals: dict[str, str], descending: bool = False, groups: list[str] | tuple[str, ...] = (),
                        partitions: int | None = None) -> DataFrame:
    """Add cumulative sums in the order of the column `by`, over the table or within each of `groups`.

    `totals` maps a summed column to the name of its running total (inclusive); `all_<name>` is the sum over the whole
    group. `by` is distinct within a group. One range shuffle over (groups, by) lays a group of any size over many
    tasks; each sums what it has of a group, and a small table of sums per range and group carries the offsets on.
    """
    groups, names = list(groups), list(totals)
    keys = [*groups, F.desc(by) if descending else F.asc(by)]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ordered = spread.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    whole = {n: isinstance(df.schema[n].dataType, _WIDE) for n in names}
    schema = T.StructType([*ordered.schema.fields, *[
        T.StructField(f"_sum_{totals[n]}", T.LongType() if whole[n] else T.DoubleType()) for n in names]])

    def add(batches):
        carried, last = None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for g in groups:
                fresh[1:] |= _differs(batch.column(g))
            key = [batch.column(g)[0] for g in groups]
            fresh[0] = carried is None or carried != key
            starts = np.flatnonzero(fresh)
            out = []
            for k, n in enumerate(names):
                values = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
                running = np.cumsum(values, dtype=np.int64 if whole[n] else np.float64)
                base = np.zeros(len(running), running.dtype)
                if len(starts):  # what was summed before a group began doesn't belong to it
                    base[starts] = np.diff(np.concatenate([[0], np.where(starts > 0, running[starts - 1], 0)]))
                    base = np.cumsum(base)
                    running = running - base
                running[:starts[0] if len(starts) else None] += last[k]
                last[k] = running[-1]
                out.append(pa.array(running))
            carried = [batch.column(g)[-1] for g in groups]
            yield pa.record_batch([*batch.columns, *out], [*batch.schema.names, *[f"_sum_{totals[n]}" for n in names]])

    local = stabilise(ordered.mapInArrow(add, schema))
    sums = local.groupBy(*groups, "_part").agg(*[F.sum(n).alias(f"_s_{totals[n]}") for n in names])
    window = W.partitionBy(*groups)
    before = window.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_part", *[x for n in names for x in (
        F.coalesce(F.sum(f"_s_{totals[n]}").over(before), F.lit(0)).alias(f"_base_{totals[n]}"),
        F.coalesce(F.sum(f"_s_{totals[n]}").over(window), F.lit(0)).alias(f"all_{totals[n]}"))])
    # A row for each range and group in it: ranges + groups rows at most.
    offsets, _ = pin_small(offsets)
    keyed = offsets.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_p"), *offsets.columns[len(groups) + 1:])
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(keyed, same).select(*df.columns, *[x for n in names for x in (
        (F.col(f"_sum_{totals[n]}") + F.col(f"_base_{totals[n]}")).alias(totals[n]), F.col(f"all_{totals[n]}"))])


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value is not the one before it; missing values are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(other, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
