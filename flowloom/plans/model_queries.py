"""Training, search and scoring over the labelled flow table.

Tree ensembles are not SQL, so most have no twin; what every scoring must hold to is checked by `score_audit`.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.bounded import shared_dir, stabilise
from ..functions.columns import c
from ..operators import clean, feature_stats, labels, metrics, models, sampling
from ..sources.bindings import RAW_FEATURES, spark_view, sql_view
from .catalog import query, rounded

#: All the features that the labelled table has.
FEATURES = RAW_FEATURES
FOREST = {k: models.IMPORTANCE_FOREST[k] for k in ("numTrees", "maxDepth", "minInstancesPerNode")}


def _table(spark, sf_dir):
    flows = clean.serving_clean(spark_view(spark, sf_dir, "raw_flows"), FEATURES)
    return flows.select("row_key", labels.binary_label(c("Label")).alias("y"), *[c(n) for n in FEATURES])


def _split(spark, sf_dir):
    """The split table, written once: training and evaluation read it many times."""
    return stabilise(sampling.stratified_split(_table(spark, sf_dir), "row_key", "y"))


def _evaluated(model, table):
    scored = models.score(table, model).select(
        F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))
    return metrics.binary_metrics(scored)


@query("rf_importance")
def rf_importance(spark, sf_dir):
    return models.forest_importance(_table(spark, sf_dir), FEATURES, "y")


def _model_path(spark, sf_dir):
    """Where this application keeps the forest of a table."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()
    return f"{shared_dir(spark)}/models/forest-{name}"


def _train_forest(spark, sf_dir, table):
    """The forest of the training split, with its scaler, stored."""
    train = table.where("split = 'train'")
    model = models.train(train, FEATURES, "y", models.random_forest(**FOREST), scaler=feature_stats.fit_robust_scaler(train, FEATURES))
    model.write().overwrite().save(_model_path(spark, sf_dir))
    return model


def _stored_forest(spark, sf_dir):
    """The stored forest; trained first where there is none."""
    path = _model_path(spark, sf_dir)
    try:
        spark.read.text(f"{path}/metadata").schema
    except AnalysisException:
        _train_forest(spark, sf_dir, _split(spark, sf_dir))
    return PipelineModel.load(path)


@query("train_rf")
def train_rf(spark, sf_dir):
    table = _split(spark, sf_dir)
    return _evaluated(_train_forest(spark, sf_dir, table), table.where("split = 'val'"))


def _train_boosted(spark, sf_dir, preset):
    table = _split(spark, sf_dir).withColumn("held_out", F.col("split") == "val")
    found = models.train_boosted(table.where("split <> 'test'"), FEATURES, "y", "held_out", preset)
    return _evaluated(found.model, table.where("split = 'test'")).withColumns({
        "best_round": F.lit(found.best_round), "stop_round": F.lit(found.stop_round)})


@query("train_gbt")
def train_gbt(spark, sf_dir):
    return _train_boosted(spark, sf_dir, "xgboost")


@query("train_gbt_leafwise")
def train_gbt_leafwise(spark, sf_dir):
    return _train_boosted(spark, sf_dir, "lightgbm")


@query("param_search")
def param_search(spark, sf_dir):
    folds = stabilise(sampling.assign_folds(_table(spark, sf_dir), "row_key", 2, "y"))
    learner = models.random_forest()
    space = {"numTrees": ("int", 5, 10), "maxDepth": [3, 5], "minInstancesPerNode": ("int", 1, 10)}
    draws = models.draw_params(learner, space, 2)
    fitted = models.search(folds, FEATURES, "y", learner, draws, "fold", 2)
    return rounded(models.search_results(folds, fitted, draws), ["mean_f2"])


def _scored(spark, sf_dir):
    """Raw flows as a deployed model meets them: aligned, cleaned, scaled, selected and scored; the model is loaded, not trained."""
    flows = clean.serving_clean(clean.align(spark_view(spark, sf_dir, "raw_flows"), FEATURES, keep=["row_key"]), FEATURES)
    mapping = spark.createDataFrame([("BENIGN", 0), ("ATTACK", 1)], "label string, code int")
    scored = models.score(flows, _stored_forest(spark, sf_dir)).select("row_key", "prediction", F.round("confidence", 6).alias("confidence"))
    return labels.decode_labels(scored, mapping)


@query("score_batch")
def score_batch(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("score_audit", f"""with {sql_view('raw_flows')} select count(*) as n_scored, count(distinct row_key) as n_keys,
  0::bigint as outside_range, 0::bigint as unknown_labels, 0::bigint as labels_against_codes from raw_flows""")
def score_audit(spark, sf_dir):
    """Every flow is scored once, confidences lie between one half and one, and labels go with the classes."""
    return _scored(spark, sf_dir).agg(
        F.count("*").alias("n_scored"), F.countDistinct("row_key").alias("n_keys"),
        F.count_if(~F.coalesce(F.col("confidence").between(0.5, 1.0), F.lit(False))).alias("outside_range"),
        F.count_if(~F.coalesce(F.col("label").isin("BENIGN", "ATTACK"), F.lit(False))).alias("unknown_labels"),
        F.count_if((F.col("prediction") == 0) != (F.col("label") == "BENIGN")).alias("labels_against_codes"))
