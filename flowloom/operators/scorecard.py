"""Comparison of registered model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import F2_WEIGHT, LATENCY_WEIGHT, MAX_FPR, MAX_LATENCY_MS
from ..functions.bounded import pin_small
from ..functions.columns import c, fbeta
from ..functions.ranks import with_position


def _f2(versions: DataFrame) -> Column:
    zero = F.lit(0.0)
    computed = fbeta(F.coalesce("precision", zero), F.coalesce("recall", zero), 2)
    return F.coalesce(F.col("f2"), computed) if "f2" in versions.columns else computed


def scorecard(versions: DataFrame, max_fpr: float = MAX_FPR, max_latency_ms: float = MAX_LATENCY_MS) -> DataFrame:
    """Constraints, status and score per version.

    A missing false positive rate is estimated from precision and flagged. A
    version that breaks either limit fails and scores 0.
    """
    precision = F.coalesce(F.col("precision"), F.lit(0.99))
    estimated = F.when(precision >= 0.98, 0.005).when(precision >= 0.95, 0.01).otherwise(1 - precision)
    judged = versions.withColumns({
        "fpr": F.coalesce(F.col("false_positive_rate"), estimated),
        "fpr_estimated": F.col("false_positive_rate").isNull(),
    }).withColumns({
        "fpr_pass": F.col("fpr") <= max_fpr,
        "latency_pass": F.coalesce(F.col("latency_ms") <= max_latency_ms, F.lit(False)),
    })
    passed = F.col("fpr_pass") & F.col("latency_pass")
    return judged.withColumns({
        "status": F.when(passed, "PASS").otherwise("FAIL"),
        "f2_component": F.when(passed, _f2(versions)).otherwise(0.0),
        "latency_component": F.when(
            passed, F.greatest(F.lit(0.0), 1 - F.col("latency_ms") / max_latency_ms)).otherwise(0.0),
    }).withColumn("score", F.col("f2_component") * F2_WEIGHT + F.col("latency_component") * LATENCY_WEIGHT)


def best_passing(scored: DataFrame) -> DataFrame:
    return scored.where("status = 'PASS'").orderBy(F.desc("score"), "model_type", "version_id").limit(1)


def intra_rank(scored: DataFrame) -> DataFrame:
    """Rank inside the model type by score, or by F1 for failing versions.

    Model types are few, so a registry is ranked by range and not by window.
    """
    merit = F.when(F.col("status") == "PASS", F.col("score")).otherwise(F.coalesce("f1", F.lit(0.0)))
    judged = scored.withColumn("merit", merit)
    totals, _ = pin_small(judged.groupBy("model_type").agg(F.count("*").alias("total_versions")))
    ranked = with_position(judged, ["model_type"], [F.desc("merit"), F.asc("version_id")], "intra_rank")
    return ranked.withColumn("intra_rank", (F.col("intra_rank") + 1).cast("int")).join(totals, "model_type")


def top_versions(scored: DataFrame, k: int = 15) -> DataFrame:
    return scored.orderBy(F.desc("score"), "model_type", "version_id").limit(k)


def plateau(scored: DataFrame) -> DataFrame:
    """F2 and recall against search effort (iterations x folds) per model type."""
    effort = F.coalesce("n_iter", F.lit(0)) * F.coalesce("cv", F.lit(1))
    return scored.select(
        "model_type", "version_id", effort.cast("long").alias("effort"), _f2(scored).alias("f2"),
        F.coalesce("recall", F.lit(0.0)).alias("recall"), "score",
    ).where("effort > 0").orderBy("model_type", "effort", "version_id")


def best_version(versions: DataFrame) -> DataFrame:
    """The version of highest F1 for every model type."""
    everything = F.struct(*[c(n) for n in versions.columns])
    best = F.min_by(everything, F.struct(-F.coalesce("f1", F.lit(0.0)), "version_id"))
    return versions.groupBy("model_type").agg(best.alias("best")).select("best.*")


def list_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy("model_type", F.desc(F.coalesce("f1", F.lit(0.0))), "version_id")


def latest_config(configs: DataFrame, model_type: str, task: str = "binary", file_name: str | None = None,
                  timestamp: str | None = None) -> DataFrame:
    """The tuning run to use: a named file, else one whose name holds `timestamp`, else the newest."""
    found = configs.where((F.col("model_type") == model_type) & (F.col("task") == task))
    if file_name is not None:
        found = found.where(F.col("file_name") == file_name.rsplit("/", 1)[-1])
    elif timestamp is not None:
        found = found.where(F.contains("file_name", F.lit(timestamp)))
    return found.orderBy(F.desc("tuning_timestamp"), F.desc("file_name")).limit(1)
