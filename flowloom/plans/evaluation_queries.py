"""Queries over predictions and registered model versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, scorecard
from .catalog import over_view, rounded

VIEW = "predictions"
CELLS = """count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 1) as fp,
  count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) filter (where y_true = 1 and y_pred = 0) as fn"""


def _div(a: str, b: str) -> str:
    return f"(case when {b} = 0 then 0.0::double else ({a}) / ({b})::double end)"


def _metrics_sql(source: str, by: str = "") -> str:
    """CTEs `m` with exact metrics per group of `by`."""
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f""", cells as (select {keys}{CELLS} from {source}{group}),
rates as (select *, {_div('tp + tn', 'tp + fp + tn + fn')} as accuracy, {_div('tp', 'tp + fp')} as "precision",
  {_div('tp', 'tp + fn')} as recall, {_div('tn', 'tn + fp')} as specificity,
  {_div('fp', 'fp + tn')} as false_positive_rate, {_div('fn', 'fn + tp')} as false_negative_rate from cells),
m as (select *, {_div('2 * "precision" * recall', '"precision" + recall')} as f1,
  {_div('5 * "precision" * recall', '4 * "precision" + recall')} as f2 from rates)"""


RATES = ["accuracy", "precision", "recall", "specificity", "false_positive_rate", "false_negative_rate", "f1", "f2"]
_RATES = ", ".join(f'round("{n}", 9) as "{n}"' for n in RATES)


@over_view("confusion_matrix", VIEW, f"select {CELLS} from predictions")
def confusion_matrix(df):
    return metrics.confusion_matrix(df)


@over_view("binary_metrics", VIEW, f"""{_metrics_sql(VIEW)} select tp, fp, tn, fn, {_RATES}, tp + fn as actual_attacks,
  tn + fp as actual_benign, tp + fp as predicted_attacks, tn + fn as predicted_benign from m""")
def binary_metrics(df):
    return rounded(metrics.binary_metrics(df), RATES, 9)


PER_CLASS = f""", classes as (select distinct true_class as class from predictions union select pred_class from predictions),
n as (select k.class, count(*) filter (where true_class = k.class and pred_class = k.class) as tp,
  count(*) filter (where true_class = k.class) as support, count(*) filter (where pred_class = k.class) as predicted
  from classes k, predictions group by k.class),
pr as (select *, {_div('tp', 'predicted')} as "precision", {_div('tp', 'support')} as recall from n),
per as (select *, {_div('2 * "precision" * recall', '"precision" + recall')} as f1 from pr)"""


@over_view("multiclass_metrics", VIEW, PER_CLASS + " select round(sum(tp) / sum(support)::double, 9) as accuracy, " + ", ".join(
    [f'round(sum("{m}" * support) / sum(support)::double, 9) as weighted_{m}' for m in ("precision", "recall", "f1")]
    + [f'round(avg("{m}"), 9) as macro_{m}' for m in ("precision", "recall", "f1")]) + " from per")
def multiclass_metrics(df):
    out = metrics.multiclass_metrics(df, "true_class", "pred_class")
    return rounded(out, out.columns, 9)


_THREE = ("precision", "recall", "f1")


@over_view("classification_report", VIEW, PER_CLASS + ", report as (select class, " + ", ".join(f'"{m}"' for m in _THREE)
           + ", support from per union all select 'accuracy', " + ", ".join(
               ["sum(tp) / sum(support)::double"] * 3) + ", cast(sum(support) as bigint) from per union all select 'macro avg', "
           + ", ".join(f'avg("{m}")' for m in _THREE) + ", cast(sum(support) as bigint) from per union all select 'weighted avg', "
           + ", ".join(f'sum("{m}" * support) / sum(support)::double' for m in _THREE)
           + ", cast(sum(support) as bigint) from per) select class, "
           + ", ".join(f'round("{m}", 9) as "{m}"' for m in _THREE) + ", support from report")
def classification_report(df):
    return rounded(metrics.classification_report(df, "true_class", "pred_class"), list(_THREE), 9)


@over_view("confusion_normalized", VIEW, """select true_class as actual, pred_class as predicted, count(*) as n,
  round(count(*) / (sum(count(*)) over (partition by true_class))::double, 9) as share
from predictions group by true_class, pred_class""")
def confusion_normalized(df):
    return rounded(metrics.confusion_normalized(df, "true_class", "pred_class"), ["share"], 9)


POINTS = """, s as (select y_prob as score, count(*) filter (where y_true = 1) as pos,
  count(*) filter (where y_true = 0) as neg from predictions group by y_prob),
p as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
  sum(pos) over () as positives, sum(neg) over () as negatives from s)"""


@over_view("roc_auc", VIEW, """, r as (select y_true, avg(rn) over (partition by y_prob) as midrank
  from (select y_true, y_prob, row_number() over (order by y_prob) as rn from predictions) x),
k as (select sum(midrank) filter (where y_true = 1) as ranks, (count(*) filter (where y_true = 1))::double as p,
  (count(*) filter (where y_true = 0))::double as n from r)
select round((ranks - p * (p + 1) / 2) / (p * n), 9) as roc_auc from k""")
def roc_auc(df):
    return rounded(metrics.roc_auc(df), ["roc_auc"], 9)


@over_view("average_precision", VIEW, POINTS + """
select round(sum((pos / positives::double) * (tp / (tp + fp)::double)), 9) as average_precision from p""")
def average_precision(df):
    return rounded(metrics.average_precision(df), ["average_precision"], 9)


#: Scores of one day in four are taken away, so that rows without one are met.
GAPPY = """, g as (select model, day, y_true, case when day % 4 = 3 and bytes % 7 = 0 then null else y_prob end as p from predictions)"""


def _gappy(df):
    missing = (F.col("day") % 4 == 3) & (F.col("bytes") % 7 == 0)
    return df.withColumn("y_prob", F.when(~missing, F.col("y_prob")))


@over_view("auc_by_group", VIEW, GAPPY + """, r as (select *, avg(rn) over (partition by model, day, p) as midrank
  from (select *, row_number() over (partition by model, day order by p) as rn from g where p is not null) x),
k as (select model, day, sum(midrank) filter (where y_true = 1) as ranks, (count(*) filter (where y_true = 1))::double as pos,
  (count(*) filter (where y_true = 0))::double as neg from r group by model, day),
d as (select model, day, p, count(*) filter (where y_true = 1) as pos, count(*) as n from g where p is not null group by model, day, p),
t as (select *, sum(pos) over w as tp, sum(n) over w as taken, sum(pos) over (partition by model, day) as positives
  from d window w as (partition by model, day order by p desc)),
a as (select model, day, case when max(positives) > 0 then sum((pos / positives::double) * (tp / taken::double)) end as ap from t group by model, day),
u as (select model, day, count(*) filter (where p is null) as unscored from g group by model, day)
select model, day, round(case when pos * neg > 0 then (ranks - pos * (pos + 1) / 2) / (pos * neg) end, 9) as roc_auc,
  round(ap, 9) as average_precision, coalesce(pos, 0)::bigint as positives, coalesce(neg, 0)::bigint as negatives, unscored
from u left join k using (model, day) left join a using (model, day)""")
def auc_by_group(df):
    return rounded(metrics.areas(_gappy(df), by=["model", "day"]), ["roc_auc", "average_precision"], 9)


@over_view("roc_by_group", VIEW, """, s as (select model, y_prob as score, count(*) filter (where y_true = 1) as pos,
  count(*) filter (where y_true = 0) as neg from predictions group by model, y_prob)
select model, score as threshold, round(sum(neg) over w / (sum(neg) over g)::double, 9) as fpr,
  round(sum(pos) over w / (sum(pos) over g)::double, 9) as tpr
from s window w as (partition by model order by score desc), g as (partition by model)""")
def roc_by_group(df):
    return rounded(metrics.roc_curve(df, by=["model"]), ["fpr", "tpr"], 9)


@over_view("roc_curve", VIEW, POINTS + """ select score as threshold, round(fp / negatives::double, 9) as fpr,
  round(tp / positives::double, 9) as tpr from p""")
def roc_curve(df):
    return rounded(metrics.roc_curve(df), ["fpr", "tpr"], 9)


@over_view("pr_curve", VIEW, POINTS + """ select score as threshold, round(tp / (tp + fp)::double, 9) as "precision",
  round(tp / positives::double, 9) as recall from p""")
def pr_curve(df):
    return rounded(metrics.pr_curve(df), ["precision", "recall"], 9)


@over_view("error_summary", VIEW, """select count(*) filter (where y_true <> y_pred) as total_errors,
  round(count(*) filter (where y_true <> y_pred) / count(*)::double, 9) as error_rate,
  count(*) filter (where y_true = 0 and y_pred = 1) as false_positives,
  count(*) filter (where y_true = 1 and y_pred = 0) as false_negatives from predictions""")
def error_summary(df):
    return rounded(metrics.error_summary(df), ["error_rate"], 9)


DESCRIBED = ["y_prob", "bytes"]


@over_view("error_describe", VIEW, ", e as (select case when y_true = 0 then 'false_positive' else 'false_negative' end as kind, "
           "y_prob, bytes from predictions where y_true <> y_pred) " + " union all ".join(
               f"""select kind, '{n}' as feature, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std,
  min(x) as min, max(x) as max, round(quantile_cont(x, 0.25), 6) as q25, round(median(x), 6) as q50,
  round(quantile_cont(x, 0.75), 6) as q75 from (select kind, cast({n} as double) as x from e) y group by kind"""
               for n in DESCRIBED))
def error_describe(df):
    return rounded(metrics.error_describe(df, DESCRIBED), ["mean", "std", "q25", "q50", "q75"])


@over_view("metrics_by_group", VIEW, f"""{_metrics_sql(VIEW, 'day')} select day, tp, fp, tn, fn, {_RATES} from m""")
def metrics_by_group(df):
    out = rounded(metrics.add_binary_metrics(metrics.confusion_matrix(df, ["day"])), RATES, 9)
    return out.select("day", "tp", "fp", "tn", "fn", *RATES)


# --------------------------------------------------------------------------- models against days

DAYS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BY_MODEL = _metrics_sql(VIEW, "model, day")


def _by_model(df):
    return metrics.binary_metrics(df, ["model", "day"])


def _pivot_sql(metric: str, mean: str) -> str:
    cells = ", ".join(f'round(max({metric}) filter (where day = {d}), 9) as "{d}"' for d in DAYS)
    return f"{BY_MODEL} select model, {cells}, round({mean}, 9) as mean_{metric} from m group by model"


@over_view("f1_pivot", VIEW, _pivot_sql("f1", "coalesce(avg(f1) filter (where f1 > 0), 0)"))
def f1_pivot(df):
    out = metrics.f1_matrix(_by_model(df), "model", "day", DAYS, "f1", positive_only=True)
    return rounded(out, [n for n in out.columns if n != "model"], 9)


@over_view("fpr_pivot", VIEW, _pivot_sql("false_positive_rate", "avg(false_positive_rate)"))
def fpr_pivot(df):
    out = metrics.f1_matrix(_by_model(df), "model", "day", DAYS, "false_positive_rate")
    return rounded(out, [n for n in out.columns if n != "model"], 9)


@over_view("rank_by_mean_f1", VIEW, BY_MODEL + """, a as (select model, coalesce(avg(f1) filter (where f1 > 0), 0) as mean_f1,
  avg(false_positive_rate) as mean_fpr from m group by model)
select model, round(mean_f1, 9) as mean_f1, round(mean_fpr, 9) as mean_fpr,
  cast(rank() over (order by a.mean_f1 desc) as integer) as rank from a""")
def rank_by_mean_f1(df):
    return rounded(metrics.rank_by_mean_f1(_by_model(df), "model"), ["mean_f1", "mean_fpr"], 9)


@over_view("acceptance_checks", VIEW, BY_MODEL + """, k as (select
  coalesce(bool_and(false_positive_rate <= 0.02) filter (where day = 1995), true) as benign_fpr_ok,
  coalesce(bool_or(f1 > 0.90) filter (where day = 2001), false) as ddos_f1_ok,
  (select max(a) from (select coalesce(avg(f1) filter (where f1 > 0), 0) as a from m group by model) x) > 0.85 as mean_f1_ok from m)
select *, benign_fpr_ok and ddos_f1_ok and mean_f1_ok as accepted from k""")
def acceptance_checks(df):
    return metrics.acceptance_checks(_by_model(df), "model", "day", 1995, 2001)


@over_view("detection_matrix", VIEW, "select day as capture, " + ", ".join(
    f"""count(*) filter (where model = {m}) as "{m}_flows", count(*) filter (where model = {m} and y_pred = 1) as "{m}_attacks",
  round(count(*) filter (where model = {m} and y_pred = 1) * 100.0::double / count(*) filter (where model = {m}), 9) as "{m}_rate" """
    for m in range(3)) + " from predictions group by rollup(day)")
def detection_matrix(df):
    out = metrics.detection_matrix(df.withColumnRenamed("day", "capture"), "model", "capture", [0, 1, 2],
                                   F.col("y_pred") == 1)
    return rounded(out, [n for n in out.columns if n.endswith("_rate")], 9)


# --------------------------------------------------------------------------- registered versions

VERSIONS = "model_versions"
SCORED = """, est as (select *, coalesce("precision", 0.99) as p0 from model_versions),
fprs as (select *, coalesce(false_positive_rate, case when p0 >= 0.98 then 0.005 when p0 >= 0.95 then 0.01 else 1 - p0 end) as fpr,
  5 * "precision" * recall / (4 * "precision" + recall) as f2 from est),
judged as (select *, fpr <= 0.01 as fpr_pass, latency_ms <= 1.0 as latency_pass,
  fpr <= 0.01 and latency_ms <= 1.0 as ok from fprs),
scored as (select *, case when ok then 'PASS' else 'FAIL' end as status,
  case when ok then 0.70::double * f2 + 0.30::double * greatest(0.0, 1 - latency_ms / 1.0) else 0.0 end as score from judged)"""


@over_view("scorecard", VERSIONS, SCORED + """ select model_type, version_id, round(fpr, 9) as fpr,
  false_positive_rate is null as fpr_estimated, fpr_pass, latency_pass, status, round(score, 9) as score from scored""")
def scorecard_query(df):
    return rounded(scorecard.scorecard(df), ["fpr", "score"], 9).select(
        "model_type", "version_id", "fpr", "fpr_estimated", "fpr_pass", "latency_pass", "status", "score")


@over_view("best_passing", VERSIONS, SCORED + """ select model_type, version_id, round(score, 9) as score from scored
  where ok order by scored.score desc, model_type, version_id limit 1""")
def best_passing(df):
    return rounded(scorecard.best_passing(scorecard.scorecard(df)).select("model_type", "version_id", "score"), ["score"], 9)


@over_view("intra_rank", VERSIONS, SCORED + """, merits as (select *, round(case when ok then score else f1 end, 9) as merit from scored)
select model_type, version_id, merit, cast(row_number() over (partition by model_type order by merit desc, version_id) as integer)
  as intra_rank, count(*) over (partition by model_type) as total_versions from merits""")
def intra_rank(df):
    return scorecard.intra_rank(rounded(scorecard.scorecard(df), ["score", "f1"], 9)).select(
        "model_type", "version_id", "merit", "intra_rank", "total_versions")


@over_view("topk_versions", VERSIONS, SCORED + """ select model_type, version_id, round(score, 9) as score from scored
  order by scored.score desc, model_type, version_id limit 15""")
def topk_versions(df):
    return rounded(scorecard.top_versions(scorecard.scorecard(df)).select("model_type", "version_id", "score"), ["score"], 9)


@over_view("plateau", VERSIONS, SCORED + """ select model_type, version_id, cast(n_iter * cv as bigint) as effort,
  round(f2, 9) as f2, recall, round(score, 9) as score from scored where n_iter * cv > 0""")
def plateau(df):
    return rounded(scorecard.plateau(scorecard.scorecard(df)), ["f2", "score"], 9)


@over_view("best_version", VERSIONS, """, n as (select *, row_number() over (partition by model_type order by f1 desc, version_id) as n
  from model_versions) select model_type, version_id, f1 from n where n = 1""")
def best_version(df):
    return scorecard.best_version(df).select("model_type", "version_id", "f1")


@over_view("latest_config", VERSIONS, """ select model_type, version_id as file_name, n_iter, cv from model_versions
  where model_type = 'xgboost' and created_day % 2 = 0 order by created_day desc, version_id desc limit 1""")
def latest_config(df):
    configs = df.select("model_type", F.col("version_id").alias("file_name"), "n_iter", "cv",
                        F.col("created_day").alias("tuning_timestamp"),
                        F.when(F.col("created_day") % 2 == 0, "binary").otherwise("multiclass").alias("task"))
    return scorecard.latest_config(configs, "xgboost").select("model_type", "file_name", "n_iter", "cv")
