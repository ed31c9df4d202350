"""JSON registries: training results, tuning runs, timing logs; the day catalogue; fitted artifacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DAYS
from ..functions.bounded import pin_small

METRICS = ("accuracy", "precision", "recall", "f1", "f2", "false_positive_rate", "false_negative_rate", "specificity")

RESULT_SCHEMA = (
    "model_name string, task string, best_params map<string,string>, best_cv_score double, "
    f"validation_metrics struct<{','.join(f'{m}:double' for m in METRICS)}>, "
    "train_time_seconds double, train_samples bigint, n_features int, early_stopping_used boolean, best_iteration int, "
    "n_jobs int, gpu_used boolean, latency_ms double, "
    "version struct<version_id:string,model_type:string,n_iter:int,cv:int,training_mode:string,created_at:string>"
)
TUNING_SCHEMA = (
    "model_type string, task string, tuning_timestamp string, tuning_method string, scoring_metric string, "
    "best_params map<string,string>, best_score double, best_f2_score double, best_latency_ms double, "
    "search_config struct<n_iterations:int,cv_folds:int,search_time_seconds:double,max_latency_constraint:double,"
    "f2_weight:double,latency_weight:double>, "
    "all_results array<struct<rank:int,params:map<string,string>,mean_score:double,std_score:double>>"
)
TIMING_SCHEMA = (
    "module string, session_id string, start_timestamp string, end_timestamp string, total_duration_seconds double, "
    "parameters map<string,string>, operations map<string,struct<duration_seconds:double>>"
)
VERSION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model_type", "version_id", "task", "model_path", "tuning_source")]
    + [T.StructField("features", T.ArrayType(T.StringType()))]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
    + [T.StructField("latency_ms", T.DoubleType()), T.StructField("n_iter", T.IntegerType()),
       T.StructField("cv", T.IntegerType()), T.StructField("train_seconds", T.DoubleType()),
       T.StructField("created_at", T.DoubleType())]
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", "_metadata.file_path")


def read_results(spark: SparkSession, root: str, task: str = "binary") -> DataFrame:
    """One row per `root/<type>/<version>/results_<task>.json`; type and version come from the path."""
    raw = _json(spark, f"{root}/*/*/results_{task}.json", RESULT_SCHEMA)
    where = r"/([^/]+)/([^/]+)/results_" + re.escape(task) + r"\.json$"
    return raw.select(
        F.regexp_extract("file_path", where, 1).alias("model_type"),
        F.regexp_extract("file_path", where, 2).alias("version_id"),
        "task", *[F.col(f"validation_metrics.{m}").alias(m) for m in METRICS],
        "latency_ms", F.col("train_time_seconds").alias("train_seconds"),
        F.col("version.n_iter").alias("n_iter"), F.col("version.cv").alias("cv"), "best_params", "file_path")


def read_tuning(spark: SparkSession, root: str) -> DataFrame:
    """One row per `root/<type>/*.json` tuning run."""
    raw = _json(spark, f"{root}/*/*.json", TUNING_SCHEMA)
    return raw.select(
        F.coalesce("model_type", F.regexp_extract("file_path", r"/([^/]+)/[^/]+\.json$", 1)).alias("model_type"),
        "task", "tuning_timestamp", F.col("tuning_method").alias("method"), "best_score",
        F.col("search_config.n_iterations").alias("n_iterations"), F.col("search_config.cv_folds").alias("cv_folds"),
        "best_params", "all_results", F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"))


def read_timing(spark: SparkSession, root: str) -> DataFrame:
    """Run logs in the shape the timing reports take."""
    raw = _json(spark, f"{root}/*.json", TIMING_SCHEMA)
    return raw.select(
        "module", "session_id", F.col("start_timestamp").alias("start"),
        F.col("total_duration_seconds").alias("total_duration"), "parameters",
        F.transform_values("operations", lambda _, v: v["duration_seconds"]).alias("operations"))


def day_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DAYS, "day string, csv string, capture string, attacks array<string>, description string")


def with_day(df: DataFrame, file_name: str = "source_file") -> DataFrame:
    """Adds day, expected attacks and description of the file a row came from."""
    days = F.broadcast(day_catalogue(df.sparkSession))  # eight rows
    return df.join(days.select(F.col("csv").alias(file_name), "day", "attacks", "description"), file_name, "left")


# --------------------------------------------------------------------------- fitted artifacts

def save_artifacts(spark: SparkSession, root: str, scaler: dict[str, tuple[float, float]], selected: list[str],
                   importances: DataFrame, reduction: DataFrame) -> None:
    """Scaler, selected features, importances and the reduction summary as small tables."""
    spark.createDataFrame(
        [(i, n, a, b) for i, (n, (a, b)) in enumerate(scaler.items())],
        "position int, feature string, centre double, spread double",
    ).coalesce(1).write.mode("overwrite").parquet(f"{root}/scaler")
    spark.createDataFrame(list(enumerate(selected)), "position int, feature string").coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/selected_features")
    importances.coalesce(1).write.mode("overwrite").parquet(f"{root}/feature_importances")
    reduction.coalesce(1).write.mode("overwrite").parquet(f"{root}/reduction")


def load_scaler(spark: SparkSession, root: str) -> dict[str, tuple[float, float]]:
    _, rows = pin_small(spark.read.parquet(f"{root}/scaler"))
    return {r.feature: (r.centre, r.spread) for r in sorted(rows, key=lambda r: r.position)}


def load_selected(spark: SparkSession, root: str) -> list[str]:
    _, rows = pin_small(spark.read.parquet(f"{root}/selected_features"))
    return [r.feature for r in sorted(rows, key=lambda r: r.position)]
