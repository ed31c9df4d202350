"""Queries over scored flows and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, timing
from ..sources.bindings import spark_view, sql_view, table
from .catalog import over_view, query, rounded

LABELLED = """, scored as (select *, row_key as flow_key, case when y_pred = 0 then 'BENIGN'
  when l.true_class = 'R' then 'DoS Hulk' else 'PortScan' end as label, y_prob as confidence from predictions l)"""
LOG = ", ".join(alerts.ATTACK_LOG)


def _scored(df):
    return df.withColumns({
        "flow_key": F.col("row_key"), "confidence": F.col("y_prob"),
        "label": F.when(F.col("y_pred") == 0, "BENIGN").when(F.col("true_class") == "R", "DoS Hulk").otherwise("PortScan")})


@over_view("alerts_filter", "predictions", LABELLED + """ select flow_key, label, confidence from scored
  where label <> 'BENIGN' and confidence >= 0.7""")
def alerts_filter(df):
    return alerts.alerts(_scored(df), 0.7).select("flow_key", "label", "confidence")


@query("session_stats", f"""with {sql_view('packets')}, {sql_view('predictions')}
select (select count(*) from packets) as packets_processed, (select count(distinct src_ip) from packets) as unique_src_ips,
  (select count(distinct dst_ip) from packets) as unique_dst_ips,
  (select (max(ts_us) - min(ts_us)) / 1e6 from packets) as duration_seconds, count(*) as flows_analyzed,
  count(*) filter (where y_pred = 1) as attacks_detected, count(*) filter (where y_pred = 0) as benign_flows,
  round(count(*) filter (where y_pred = 1) * 100.0::double / count(*), 9) as detection_rate from predictions""")
def session_stats(spark, sf_dir):
    out = alerts.session_stats(spark_view(spark, sf_dir, "packets"), _scored(spark_view(spark, sf_dir, "predictions")))
    return rounded(out, ["detection_rate"], 9)


@over_view("predictions_by_label", "predictions", LABELLED + " select label, count(*) as n from scored group by label")
def predictions_by_label(df):
    return alerts.predictions_by_label(_scored(df))


@over_view("attack_log", "predictions", LABELLED + f" select {LOG} from scored where label <> 'BENIGN'")
def attack_log(df):
    return alerts.attack_log(_scored(df))


@over_view("block_list", "predictions", LABELLED + """, hits as (select *, row_number() over (partition by src_ip
  order by ts_us, flow_key) as n from scored where label <> 'BENIGN' and confidence >= 0.7)
select src_ip as ip, ts_us as blocked_us, label as reason from hits where n = 1""")
def block_list(df):
    return alerts.block_list(_scored(df))


@over_view("topk_attacks", "predictions", LABELLED + f" select {LOG} from scored where label <> 'BENIGN' order by ts_us, flow_key limit 100")
def topk_attacks(df):
    return alerts.first_attacks(_scored(df))


# --------------------------------------------------------------------------- run logs

RUNS = f"""with {sql_view('timing_runs')}, ops as (select l_orderkey as session_id, 'step_' || l_linenumber as operation,
  sum(l_quantity) as seconds from lineitem group by 1, 2),
detail as (select r.module, r.session_id, r.total_duration, o.operation, o.seconds from timing_runs r join ops o using (session_id))"""


def _runs(spark, sf_dir):
    runs = spark_view(spark, sf_dir, "timing_runs").withColumn("start", F.col("start_day").cast("string"))
    steps = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("step_"), "l_linenumber").alias("operation"))
        .agg(F.sum("l_quantity").alias("seconds"))
        .groupBy("session_id")  # the steps of one run: as many as its log names
        .agg(F.map_from_entries(F.collect_list(F.struct("operation", "seconds"))).alias("operations"))
    )
    return runs.join(steps, "session_id", "left").withColumn(
        "parameters", F.create_map(F.lit("status"), F.col("status")))


_STATS = """count(*) as executions, min({v}) as min_seconds, max({v}) as max_seconds, round(avg({v}), 6) as mean_seconds"""


@query("timing_by_module", f"with {sql_view('timing_runs')} select module, {_STATS.format(v='total_duration')} "
       "from timing_runs group by module")
def timing_by_module(spark, sf_dir):
    return rounded(timing.by_module(spark_view(spark, sf_dir, "timing_runs")), ["mean_seconds"])


@query("timing_by_operation", f"{RUNS} select module, operation, {_STATS.format(v='seconds')} from detail group by module, operation")
def timing_by_operation(spark, sf_dir):
    return rounded(timing.by_operation(_runs(spark, sf_dir)), ["mean_seconds"])


@query("timing_params", f"with {sql_view('timing_runs')} select distinct module, 'status' as parameter, status as value from timing_runs")
def timing_params(spark, sf_dir):
    return timing.parameter_values(_runs(spark, sf_dir))


@query("timing_recent", f"""with {sql_view('timing_runs')} select module, session_id, cast(start_day as varchar) as start, total_duration
  from timing_runs order by start_day desc, session_id desc limit 10""")
def timing_recent(spark, sf_dir):
    runs = spark_view(spark, sf_dir, "timing_runs").withColumn("start", F.col("start_day").cast("string"))
    return timing.recent(runs).select("module", "session_id", "start", "total_duration")


@query("timing_share", f"{RUNS} select module, session_id, operation, round(seconds / total_duration * 100, 6) as percent from detail")
def timing_share(spark, sf_dir):
    return rounded(timing.operation_share(_runs(spark, sf_dir)), ["percent"]).select(
        "module", "session_id", "operation", "percent")
