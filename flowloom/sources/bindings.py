"""The test tables seen as packets, labelled flows, predictions, model versions and timing runs.

Each view is written once, as SQL expressions that Spark and an ANSI SQL engine
both accept; `sql_view` and `spark_view` render the same text for either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "cast(regexp_extract(props,'([0-9]+)',1) as int)"
FWD = "event_type in ('click','view','signup')"
CLIENT, SERVER = "'10.0.0.' || cast(user_id as string)", "'10.0.1.' || cast(event_id % 3 as string)"
UDP_TEST = f"{K} % 10 = 0"
HEADER = f"case when {UDP_TEST} then 28 else 40 end"
PAYLOAD = "cast(floor(value) as int)"

PACKETS = {
    "packet_id": "event_id",
    "ts_us": "{micros}",
    "src_ip": f"case when {FWD} then {CLIENT} else {SERVER} end",
    "dst_ip": f"case when {FWD} then {SERVER} else {CLIENT} end",
    "src_port": f"cast(case when {FWD} then 40000 + user_id else 443 end as int)",
    "dst_port": f"cast(case when {FWD} then 443 else 40000 + user_id end as int)",
    "protocol": f"case when {UDP_TEST} then 17 else 6 end",
    "header_len": HEADER,
    "payload_len": PAYLOAD,
    "packet_len": f"{HEADER} + {PAYLOAD}",
    "tcp_flags": f"case when {UDP_TEST} then 0 when event_type = 'signup' then 2 when event_type = 'click' then 24 "
                 "when event_type = 'view' then 16 when event_type = 'purchase' then 17 else 4 end",
    "window_size": f"case when {UDP_TEST} then 0 else {K} * 655 end",
}

ROW_KEY = ("concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
           "cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))")
LABEL = "case l_returnflag when 'N' then ' Benign ' when 'R' then 'DoS Hulk' else 'PortScan' end"
INFINITY = "cast('Infinity' as double)"

RAW_FLOWS = {
    "row_key": ROW_KEY,
    "Flow ID": ROW_KEY,
    "Source Port": "l_suppkey",
    "Flow Duration": "l_quantity",
    "Flow Bytes/s": f"case when l_partkey % 97 = 0 then {INFINITY} else l_extendedprice end",
    "Flow IAT Mean": "case when l_suppkey % 13 = 0 then cast(null as double) else l_discount end",
    "Fwd IAT Mean": "l_tax",
    "Subflow Fwd Bytes": "l_quantity * 2",
    "Fwd Avg Bytes/Bulk": "cast(0.0 as double)",
    "Label": LABEL,
    "source_file": "cast(extract(year from l_shipdate) as int)",
}
RAW_FEATURES = ["Flow Duration", "Flow Bytes/s", "Flow IAT Mean", "Fwd IAT Mean", "Subflow Fwd Bytes",
                "Fwd Avg Bytes/Bulk"]

PREDICTIONS = {
    "row_key": ROW_KEY,
    "y_true": "case when l_returnflag <> 'N' then 1 else 0 end",
    "y_prob": "cast(round(l_quantity / 50.0 * 0.5 + (case when l_returnflag <> 'N' then 0.3 else 0.1 end) "
              "+ l_discount * 2, 4) as double)",
    "y_pred": "case when round(l_quantity / 50.0 * 0.5 + (case when l_returnflag <> 'N' then 0.3 else 0.1 end) "
              "+ l_discount * 2, 4) >= 0.5 then 1 else 0 end",
    "true_class": "l_returnflag",
    "pred_class": "case l_partkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end",
    "model": "cast(l_linenumber % 3 as int)",
    "day": "cast(extract(year from l_shipdate) as int)",
    "src_ip": "'10.1.' || cast(l_suppkey % 256 as string) || '.' || cast(l_suppkey % 7 as string)",
    "dst_ip": "'10.2.0.' || cast(l_partkey % 50 as string)",
    "src_port": "cast(l_suppkey as int)",
    "dst_port": "443",
    "protocol": "6",
    "packets": "cast(l_quantity as bigint)",
    "bytes": "cast(round(l_extendedprice) as bigint)",
    "duration_us": "cast(round(l_discount * 1000000) as bigint)",
    "ts_us": "{ship_micros}",
}

MODEL_VERSIONS = {
    "model_type": "case p_partkey % 3 when 0 then 'random_forest' when 1 then 'xgboost' else 'lightgbm' end",
    "version_id": "p_name || cast(p_partkey as string)",
    "precision": "cast(0.90 + p_size * 0.002 as double)",
    "recall": "cast(0.95 + (p_partkey % 50) * 0.001 as double)",
    "false_positive_rate": "case when p_partkey % 4 = 0 then cast(null as double) "
                           "else cast((p_partkey % 30) * 0.001 as double) end",
    "f1": "cast(0.90 + (p_partkey % 97) * 0.001 as double)",
    "latency_ms": "cast(p_retailprice / 950.0 as double)",
    "n_iter": "p_size * 10",
    "cv": "cast(2 + p_partkey % 6 as int)",
    "created_day": "cast(p_partkey as int)",
}

TIMING_RUNS = {
    "module": "o_orderpriority",
    "session_id": "o_orderkey",
    "start_day": "cast(o_orderdate as date)",
    "total_duration": "o_totalprice / 100",
    "status": "o_orderstatus",
}

VIEWS = {
    "packets": ("events", PACKETS),
    "raw_flows": ("lineitem", RAW_FLOWS),
    "predictions": ("lineitem", PREDICTIONS),
    "model_versions": ("part", MODEL_VERSIONS),
    "timing_runs": ("orders", TIMING_RUNS),
}

_SPARK_TIME = {
    "micros": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)",
    "ship_micros": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)",
}
_SQL_TIME = {"micros": "epoch_us(ts)", "ship_micros": "epoch_us(l_shipdate)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, source).selectExpr(
        *[f"{text.format(**_SPARK_TIME)} as `{alias}`" for alias, text in columns.items()])


def sql_view(name: str) -> str:
    """A common table expression for the same view."""
    source, columns = VIEWS[name]
    body = ", ".join(f'{text.format(**_SQL_TIME)} as "{alias}"' for alias, text in columns.items())
    return f"{name} as (select {body} from {source})"
