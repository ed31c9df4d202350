"""JSON-lines sinks for flows, attacks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c
from ..operators.alerts import attack_log


def flow_log_rows(scored: DataFrame, features: list[str]) -> DataFrame:
    """`flow_key, prediction, label, confidence, ts_us` and the features as one map."""
    cells = [x for n in features for x in (F.lit(n), c(n).cast("double"))]
    return scored.select("flow_key", "prediction", "label", "confidence", "ts_us", F.create_map(*cells).alias("features"))


def write_flow_log(scored: DataFrame, features: list[str], path: str) -> None:
    flow_log_rows(scored, features).write.mode("append").json(path)


def write_attack_log(scored: DataFrame, path: str) -> None:
    attack_log(scored).write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """An evaluation report: a few metric rows in one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
