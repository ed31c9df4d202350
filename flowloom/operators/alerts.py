"""What follows from scored flows: alerts, logs, block list, session statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, side_by_side

BENIGN = "BENIGN"


def alerts(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Flows labelled as anything but benign, optionally only at or above a confidence."""
    out = scored.where(F.col("label") != BENIGN)
    return out if threshold is None else out.where(F.col("confidence") >= threshold)


def predictions_by_label(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count("*").alias("n"))


def session_stats(packets: DataFrame, scored: DataFrame) -> DataFrame:
    """Packets, flows, attacks, benign flows, distinct addresses and covered time, as one row."""
    traffic = packets.agg(
        F.count("*").alias("packets_processed"), F.countDistinct("src_ip").alias("unique_src_ips"),
        F.countDistinct("dst_ip").alias("unique_dst_ips"),
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_seconds"))
    verdicts = scored.agg(
        F.count("*").alias("flows_analyzed"), F.count_if(F.col("label") != BENIGN).alias("attacks_detected"),
        F.count_if(F.col("label") == BENIGN).alias("benign_flows"))
    return side_by_side(traffic, verdicts).withColumn(
        "detection_rate", ratio(F.col("attacks_detected"), F.col("flows_analyzed")) * 100)


COUNTS = ("packets long, bytes long, flows_analyzed long, attacks_detected long, first_us long, last_us long, "
          "src_sketch string, dst_sketch string")
BLOCKS = "ip string, blocked_us long, reason string"
#: Logarithm of the registers of an address sketch: 16,384, an error of about one in a hundred; some thousand addresses are counted exactly.
SKETCH_LOG_REGISTERS = 14


def _senders(scored: DataFrame) -> tuple[Column, Column]:
    """Addresses that sent and that received packets of a flow, as arrays: of both ends where the flow went both ways."""
    if {"Total Fwd Packets", "Total Backward Packets"} <= set(scored.columns):
        there, back = (F.coalesce(F.col(n), F.lit(0)) > 0 for n in ("Total Fwd Packets", "Total Backward Packets"))
        return (F.array(F.when(there, F.col("src_ip")), F.when(back, F.col("dst_ip"))),
                F.array(F.when(there, F.col("dst_ip")), F.when(back, F.col("src_ip"))))
    return F.array("src_ip"), F.array("dst_ip")


def verdict_counts(scored: DataFrame) -> DataFrame:
    """One row that can be added to others: what a batch of scored flows contributes to the session.

    Distinct addresses can't be added, so they are in the row as mergeable sketches of bounded size.
    """
    sources, targets = _senders(scored)
    sketches = [F.base64(F.hll_union_agg(F.col(n), F.lit(True))).alias(n) for n in ("src_sketch", "dst_sketch")]
    ends = scored.select(sources.alias("s"), targets.alias("t"))
    parts = [ends.select(F.explode(x).alias("ip")).where("ip is not null").agg(F.hll_sketch_agg("ip", F.lit(SKETCH_LOG_REGISTERS)).alias(n))
             for x, n in (("s", "src_sketch"), ("t", "dst_sketch"))]
    addresses = parts[0].unionByName(parts[1], allowMissingColumns=True).agg(*sketches)
    return side_by_side(scored.agg(
        F.sum("packets").cast("long").alias("packets"), F.sum("bytes").cast("long").alias("bytes"),
        F.count("*").alias("flows_analyzed"), F.count_if(F.col("label") != BENIGN).alias("attacks_detected"),
        F.min("ts_us").alias("first_us"), F.max(F.col("ts_us") + F.col("duration_us").cast("long")).alias("last_us")), addresses)


def total_verdicts(counts: DataFrame) -> DataFrame:
    """The session's totals from the rows of `verdict_counts`; distinct addresses are estimated from the merged sketches."""
    distinct = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.unbase64(n), F.lit(True))), F.lit(0)).cast("long").alias(out)
                for n, out in (("src_sketch", "unique_src_ips"), ("dst_sketch", "unique_dst_ips"))]
    total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("packets", "bytes", "flows_analyzed", "attacks_detected")],
                       ((F.max("last_us") - F.min("first_us")) / 1e6).alias("duration_seconds"), *distinct)
    return total.withColumn("benign_flows", F.col("flows_analyzed") - F.col("attacks_detected")).withColumn(
        "detection_rate", ratio(F.col("attacks_detected"), F.col("flows_analyzed")) * 100)


ATTACK_LOG = ["ts_us", "flow_key", "label", "confidence", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
              "packets", "bytes", "duration_us"]


def attack_log(scored: DataFrame) -> DataFrame:
    return alerts(scored).select(*ATTACK_LOG)


def block_list(scored: DataFrame, threshold: float = 0.7, source: str | None = None, key: str = "flow_key") -> DataFrame:
    """Source addresses with a confident alert: first time, and the label of that first alert.

    The source is the sender of a flow's first packet where the table knows it, else `src_ip`.
    """
    source = source or ("initiator_ip" if "initiator_ip" in scored.columns else "src_ip")
    four_parts = F.size(F.split(F.col(source), r"\.")) == 4
    return alerts(scored, threshold).where(four_parts).groupBy(F.col(source).alias("ip")).agg(
        F.min("ts_us").alias("blocked_us"), F.min_by("label", F.struct("ts_us", key)).alias("reason"))


def first_attacks(scored: DataFrame, k: int = 100, key: str = "flow_key") -> DataFrame:
    return attack_log(scored).orderBy("ts_us", key).limit(k)


def on_attack(callback: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Turn a function of an alert table into a `foreachBatch` handler; works on a batch table as well."""
    def handle(batch: DataFrame, batch_id: int = 0) -> None:
        callback(alerts(batch))

    return handle
