"""Reports over run logs: `(module, session_id, start, total_duration, operations, parameters)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def _summary(value: str):
    return [F.count("*").alias("executions"), F.min(value).alias("min_seconds"), F.max(value).alias("max_seconds"),
            F.avg(value).alias("mean_seconds")]


def by_module(runs: DataFrame) -> DataFrame:
    return runs.groupBy("module").agg(*_summary("total_duration"))


def operation_rows(runs: DataFrame) -> DataFrame:
    """One row per run and operation; internal operations (leading underscore) are left out."""
    exploded = runs.select("module", "session_id", "total_duration", F.explode("operations").alias("operation", "seconds"))
    return exploded.where(~F.startswith("operation", F.lit("_")))


def by_operation(runs: DataFrame) -> DataFrame:
    return operation_rows(runs).groupBy("module", "operation").agg(*_summary("seconds"))


def parameter_values(runs: DataFrame) -> DataFrame:
    """Distinct values seen per module and parameter, one row each."""
    return runs.select("module", F.explode("parameters").alias("parameter", "value")).distinct()


def recent(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("start"), F.desc("session_id")).limit(k)


def operation_share(runs: DataFrame) -> DataFrame:
    """Share of each operation in the total time of its run, in percent."""
    return operation_rows(runs).withColumn("percent", ratio(F.col("seconds"), F.col("total_duration")) * 100)
