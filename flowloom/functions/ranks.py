"""Positions inside groups of any size, by one range shuffle.

A window over a group puts the group into one task. A range shuffle over
(group, order) does not: it samples the keys and lays a large group over as many
partitions as it needs, ties included. The sorted rows are written once, with
their partition number, so that every later step sees the same placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bounded import pin_small, stabilise


def placed(df: DataFrame, by: list[str], order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """Rows in (by, order) with `_part`, the sorted partition they lie in, and `_place`, ascending inside it.

    Without `partitions` the session's shuffle partitions apply.
    """
    keys = [*by, *order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return stabilise(
        spread.sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))


def with_position(df: DataFrame, by: list[str], order: list[Column | str], name: str = "position",
                  partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of a row inside its group. `order` should leave no ties that matter."""
    rows = placed(df, by, order, partitions)
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")).select(
        *by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    # A row per group and partition it touches: groups + partitions rows at most.
    shifts, _ = pin_small(shifts)
    return rows.join(shifts, [*by, "_part"]).withColumn(name, F.col("_place") + F.col("_shift")).drop(
        "_place", "_part", "_shift")
