"""Classification metrics as aggregates over `(y_true, y_pred, y_prob)` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import pin_small
from ..functions.columns import c, fbeta, is_missing, ratio, side_by_side
from ..functions.quantiles import quantiles_of
from ..functions.running import with_running_totals


def _cells(truth: str = "y_true", pred: str = "y_pred") -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    return [F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 1) & (p == 0)).alias("fn")]


def confusion_matrix(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Always the four counts tp, fp, tn, fn, even when a class is absent."""
    return df.groupBy(*by).agg(*_cells())


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(c(truth).alias("actual"), c(pred).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_normalized(df: DataFrame, truth: str, pred: str) -> DataFrame:
    counts = confusion_counts(df, truth, pred)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("actual")))


def add_binary_metrics(cells: DataFrame) -> DataFrame:
    """Metrics from tp, fp, tn, fn; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    out = cells.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    })
    return out.withColumns({
        "f1": fbeta(F.col("precision"), F.col("recall"), 1), "f2": fbeta(F.col("precision"), F.col("recall"), 2)})


def binary_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """All binary metrics with the class and prediction totals, per group of `by` in one job."""
    out = add_binary_metrics(confusion_matrix(df, by))
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    return out.withColumns({
        "actual_attacks": tp + fn, "actual_benign": tn + fp,
        "predicted_attacks": tp + fp, "predicted_benign": tn + fn})


# --------------------------------------------------------------------------- several classes

def per_class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class seen on either side."""
    counts = confusion_counts(df, truth, pred)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )))
    sums = sides.groupBy("class").agg(*[F.sum(n).alias(n) for n in ("tp", "support", "predicted")])
    rates = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return rates.withColumn("f1", fbeta(F.col("precision"), F.col("recall"), 1))


_RATES = ("precision", "recall", "f1")


def multiclass_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    per_class = per_class_metrics(df, truth, pred)
    support = F.sum("support")
    return per_class.agg(
        (F.sum("tp") / support).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(f"weighted_{m}") for m in _RATES],
        *[F.avg(m).alias(f"macro_{m}") for m in _RATES],
    )


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row per class, then accuracy, the macro and the weighted average."""
    per_class = per_class_metrics(df, truth, pred)
    support = F.sum("support")
    averages = per_class.agg(
        support.alias("support"), (F.sum("tp") / support).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in _RATES],
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(f"weighted_{m}") for m in _RATES],
    )
    summary = averages.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in _RATES], "support"),
        *[F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{m}").alias(m) for m in _RATES], "support")
          for kind in ("macro", "weighted")],
    )))
    return per_class.select(F.col("class").cast("string").alias("class"), *_RATES, "support").unionByName(summary)


# --------------------------------------------------------------------------- score curves

def score_counts(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives per group and distinct score. Rows without a score are under NULL, as `unscored` alone."""
    value = c(score).cast("double")
    rows = df.select(*[c(b) for b in by], F.when(~is_missing(value), value).alias("score"), c(truth).alias("_truth"))
    scored = F.col("score").isNotNull()
    return rows.groupBy(*[c(b) for b in by], "score").agg(
        F.count_if(scored & (F.col("_truth") == 1)).alias("pos"), F.count_if(scored & (F.col("_truth") == 0)).alias("neg"),
        F.count_if(~scored).alias("unscored"))


def _points(df: DataFrame, score: str, truth: str, descending: bool, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Per group and distinct score: positives (tp) and negatives (fp) up to it in this order, and those of the group."""
    counts = score_counts(df, score, truth, by)
    return with_running_totals(counts, "score", {"pos": "tp", "neg": "fp"}, descending, by)


def curves(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """`(threshold, tp, fp, positives, negatives)` per group and distinct score, classifying score >= threshold as positive."""
    return _points(df, score, truth, True, by).where("score is not null").select(
        *[c(b) for b in by], F.col("score").alias("threshold"), "tp", "fp", F.col("all_tp").alias("positives"), F.col("all_fp").alias("negatives"))


def roc_curve(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """`(threshold, fpr, tpr)` per group and distinct score."""
    return curves(df, score, truth, by).select(
        *[c(b) for b in by], "threshold", ratio(F.col("fp"), F.col("negatives")).alias("fpr"), ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def pr_curve(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return curves(df, score, truth, by).select(
        *[c(b) for b in by], "threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"))


def areas(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Per group: `roc_auc` and `average_precision`, and how many positives, negatives and rows without a score there are.

    The area under the ROC curve is taken from mid-ranks of score groups and is NULL with one class only: each
    positive beats the negatives below its score and ties half of those at it. Both areas come from one ascending pass.
    """
    points = _points(df, score, truth, False, by)  # fp counts the negatives at or below a score
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    wins = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    tp, fp = F.col("all_tp") - F.col("tp") + F.col("pos"), F.col("all_fp") - F.col("fp") + F.col("neg")
    # NULL comes first in this order and holds neither class.
    weighted = F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)))
    return points.groupBy(*[c(b) for b in by]).agg(
        F.when(pos * neg > 0, wins / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"),
        F.when(pos > 0, weighted / F.nullif(pos, F.lit(0.0))).alias("average_precision"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(out) for n, out in (("pos", "positives"), ("neg", "negatives"), ("unscored", "unscored"))])


def roc_auc(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return areas(df, score, truth, by).select(*[c(b) for b in by], "roc_auc")


def average_precision(df: DataFrame, score: str = "y_prob", truth: str = "y_true", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return areas(df, score, truth, by).select(*[c(b) for b in by], "average_precision")


# --------------------------------------------------------------------------- errors

def _error_kind() -> Column:
    return F.when((F.col("y_true") == 0) & (F.col("y_pred") == 1), "false_positive").when(
        (F.col("y_true") == 1) & (F.col("y_pred") == 0), "false_negative")


def error_summary(df: DataFrame) -> DataFrame:
    wrong = F.col("y_true") != F.col("y_pred")
    return df.agg(
        F.count_if(wrong).alias("total_errors"), ratio(F.count_if(wrong), F.count("*")).alias("error_rate"),
        F.count_if(_error_kind() == "false_positive").alias("false_positives"),
        F.count_if(_error_kind() == "false_negative").alias("false_negatives"))


def error_describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each feature, per kind of error."""
    wrong = df.select(_error_kind().alias("kind"), *[c(n).cast("double").alias(n) for n in features]).where(
        "kind is not null")
    long = wrong.select("kind", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), c(n).alias("value")) for n in features])))
    stats = long.groupBy("kind", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    cells = [(kind, n) for kind in ("false_positive", "false_negative") for n in features]
    quartiles = quantiles_of(wrong, [F.when(F.col("kind") == kind, c(n)) for kind, n in cells], [0.25, 0.5, 0.75])
    rows = [(*cell, *q) for cell, q in zip(cells, quartiles, strict=True)]
    table = F.broadcast(df.sparkSession.createDataFrame(  # two rows per feature
        rows, "kind string, feature string, q25 double, q50 double, q75 double"))
    return stats.join(table, ["kind", "feature"])


# --------------------------------------------------------------------------- model by file

def f1_matrix(scores: DataFrame, model: str, file: str, files: list, metric: str,
              positive_only: bool = False) -> DataFrame:
    """One row per model, a column per file, and `mean_<metric>` (over positive values only if asked)."""
    value = F.when(F.col(metric) > 0, F.col(metric)) if positive_only else F.col(metric)
    means = scores.groupBy(model).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{metric}"))
    wide = scores.groupBy(model).pivot(file, files).agg(F.first(metric))
    means, _ = pin_small(means)
    return wide.join(means, model)


def rank_by_mean_f1(scores: DataFrame, model: str) -> DataFrame:
    per_model = scores.groupBy(model).agg(
        F.coalesce(F.avg(F.when(F.col("f1") > 0, F.col("f1"))), F.lit(0.0)).alias("mean_f1"),
        F.avg("false_positive_rate").alias("mean_fpr"))
    return per_model.withColumn("rank", F.rank().over(W.orderBy(F.desc("mean_f1"))))


def acceptance_checks(scores: DataFrame, model: str, file: str, benign_file, ddos_file,
                      max_fpr: float = 0.02, min_f1: float = 0.90, min_mean_f1: float = 0.85) -> DataFrame:
    """The release checklist: quiet on benign traffic, strong on DDoS, one good model overall."""
    checks = scores.agg(
        F.coalesce(F.bool_and(F.when(F.col(file) == benign_file, F.col("false_positive_rate") <= max_fpr)),
                   F.lit(True)).alias("benign_fpr_ok"),
        F.coalesce(F.bool_or(F.when(F.col(file) == ddos_file, F.col("f1") > min_f1)), F.lit(False)).alias("ddos_f1_ok"))
    best = rank_by_mean_f1(scores, model).agg(
        F.coalesce(F.max("mean_f1") > min_mean_f1, F.lit(False)).alias("mean_f1_ok"))
    return side_by_side(checks, best).withColumn("accepted", F.col("benign_fpr_ok") & F.col("ddos_f1_ok") & F.col("mean_f1_ok"))


def detection_matrix(df: DataFrame, model: str, capture: str, models: list, attack: Column) -> DataFrame:
    """Per capture, and in total (`capture` NULL): flows, attacks and detection rate for every model."""
    cells = []
    for m in models:
        mine = F.col(model) == m
        cells += [
            F.count_if(mine).alias(f"{m}_flows"), F.count_if(mine & attack).alias(f"{m}_attacks"),
            (ratio(F.count_if(mine & attack), F.count_if(mine)) * 100).alias(f"{m}_rate"),
        ]
    return df.rollup(capture).agg(*cells)
