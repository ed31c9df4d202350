"""The end-to-end jobs: prepare a data set, fit its features, evaluate by file, detect on captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.bounded import stabilise
from .functions.columns import c, numeric_columns
from .operators import clean, feature_stats, flow_features, labels, metrics, models, sampling
from .operators.flows import FlowRules, segment


def prepare_dataset(raw: DataFrame, ratio: float | None = 2.0, test: float = 0.15, val: float = 0.15,
                    seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Labelled flows to a cleaned, encoded, balanced and split table, and the label mapping.

    Rows are distinct after cleaning, so their content is the key that sampling hashes.
    """
    cleaned = clean.clean(raw)
    keyed = cleaned.withColumn("_key", F.md5(F.concat_ws(
        "|", *[F.coalesce(c(n).cast("string"), F.lit("")) for n in cleaned.columns]).cast("binary")))
    encoded, mapping = labels.encode_labels(stabilise(keyed))
    if ratio is not None:
        encoded = sampling.balance(encoded, "_key", ratio, seed=seed)
    return sampling.stratified_split(encoded, "_key", test=test, val=val, seed=seed).drop("_key"), mapping


@dataclass(frozen=True)
class FeatureSet:
    """What is fitted on the training split: the kept features, their scaling, and the selected ones."""

    kept: list[str]
    scaler: dict[str, tuple[float, float]]
    selected: list[str]


def fit_features(train: DataFrame, target: str = "Label_Binary", variance: float = 0.0, correlation: float = 0.95,
                 top: int = 30, robust: bool = True, **forest) -> tuple[FeatureSet, DataFrame]:
    """Variance filter, correlation filter, scaler, forest importance; and the importance table."""
    names = [n for n in numeric_columns(train) if n in set(clean.feature_columns(train))]
    kept = feature_stats.correlation_filter(
        train, feature_stats.variance_filter(train, names, variance), correlation)
    fit = feature_stats.fit_robust_scaler if robust else feature_stats.fit_standard_scaler
    importances = models.forest_importance(train, kept, target, **forest)
    selected = [r.feature for r in feature_stats.top_features(importances, top).collect()]
    return FeatureSet(kept, fit(train, kept), selected), importances


def train_model(train: DataFrame, features: FeatureSet, learner, target: str = "Label_Binary") -> PipelineModel:
    return models.train(train, features.selected, target, learner, scaler=features.scaler)


def evaluate_by_file(raw: DataFrame, model: PipelineModel, wanted: list[str], by: str = "source_file") -> DataFrame:
    """Metrics of a binary model on every labelled file, in one job."""
    table = clean.normalise_label(raw)
    aligned = clean.align(table, wanted, keep=[by, "Label"])
    scored = models.score(clean.serving_clean(aligned, wanted), model)
    return metrics.binary_metrics(scored.select(
        by, labels.binary_label(F.col("Label")).alias("y_true"), F.col("prediction").alias("y_pred")), [by])


def score_flows(segmented: DataFrame, rules: FlowRules, model: PipelineModel, mapping: DataFrame) -> DataFrame:
    """Packets of closed flows to scored, labelled flows with the columns the logs and alerts use."""
    features = flow_features.sanitised(flow_features.features_of(segmented, rules))
    scored = labels.decode_labels(models.score(features, model), mapping)
    return scored.withColumnsRenamed(
        {"lo_ip": "src_ip", "lo_port": "src_port", "hi_ip": "dst_ip", "hi_port": "dst_port"}
    ).withColumns({
        "ts_us": F.col("start_us"), "packets": F.col("Total Fwd Packets") + F.col("Total Backward Packets"),
        "bytes": F.col("Total Length of Fwd Packets") + F.col("Total Length of Bwd Packets"),
        "duration_us": F.col("Flow Duration")})


def detect(packets: DataFrame, model: PipelineModel, mapping: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """All flows of a packet table, scored; `alerts`, `sinks` and `session_stats` take it from here."""
    return score_flows(segment(packets, rules), rules, model, mapping)
