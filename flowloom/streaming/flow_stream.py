"""Flows from an unbounded packet stream.

Packets are keyed by flow key; the state of a key holds the packets of its open
flow (at most `max_packets`) and those the watermark has not passed yet. Packets
are taken in time order once the watermark has passed them, so disorder within
the watermark delay changes nothing. A closed flow leaves as its packets, in the
shape of the batch segmentation, and the same feature code serves both.

The state machine of a key is sequential by nature, so one key runs in one task;
capture-scale history with very hot keys belongs to the batch path.

When the input has ended, the packets of flows that are still open lie in the state of the finished query.
`remaining_flow_packets` reads them from its checkpoint and closes them in one batch job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import workflows
from ..operators import alerts
from ..operators.flows import ENDPOINTS, FLOW, MEASURES, FlowRules, is_closing_packet, keep_tcp_udp, segment, with_flow_key
from ..operators.hot_keys import next_starts
from ..sources import sinks

PACKET_SCHEMA = ("packet_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, "
                 "protocol int, header_len int, payload_len int, packet_len int, tcp_flags int, window_size int")
_TEXT, _INT, _LONG, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
STATE = T.StructType([T.StructField(n, t) for n, t in {
    "lo_ip": _TEXT, "lo_port": _INT, "hi_ip": _TEXT, "hi_port": _INT, "protocol": _INT,
    "ts_us": _LONG, "packet_id": _LONG, "closes": _FLAG, "is_forward": _FLAG,
    "header_len": _INT, "payload_len": _INT, "packet_len": _INT, "tcp_flags": _INT, "window_size": _INT}.items()])
OUTPUT = T.StructType([T.StructField("flow_key", _TEXT), T.StructField("flow_pos", _LONG),
                       T.StructField("packet_no", _INT), *STATE.fields])


def packet_stream(spark: SparkSession, path: str, file_format: str = "parquet", delay: str = "2 minutes",
                  files_per_trigger: int | None = None) -> DataFrame:
    """Packet records landing as files in a folder, with an event time and a watermark."""
    reader = spark.readStream.schema(PACKET_SCHEMA).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


class FlowProcessor(StatefulProcessor):
    def __init__(self, rules: FlowRules):
        self.rules = rules

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", STATE)

    def handleInputRows(self, key, rows, timerValues):
        names = STATE.fieldNames()
        new = pd.concat(list(rows), ignore_index=True)[names]
        old = pd.DataFrame([tuple(r) for r in self.held.get()], columns=names) if self.held.exists() else None
        yield from self._advance(key, new if old is None else pd.concat([old, new], ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            rows = pd.DataFrame([tuple(r) for r in self.held.get()], columns=STATE.fieldNames())
            yield from self._advance(key, rows, timerValues)

    def _advance(self, key, packets, timerValues):
        rules = self.rules
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        packets = packets.sort_values(["ts_us", "packet_id"], ignore_index=True)
        ts, closes = packets.ts_us.to_numpy("int64"), packets.closes.to_numpy(bool)
        ready = int((ts <= watermark).sum())
        jump = next_starts(ts[:ready], closes[:ready], rules) if ready else []
        begin, done = 0, []
        while begin < ready:
            end = int(jump[begin])
            span, n = ts[end - 1] - ts[begin], end - begin
            closed = (
                end < ready or n >= rules.max_packets or span > rules.active_timeout
                or (closes[begin:end].any() and n >= rules.min_closing_packets)
                or watermark - ts[end - 1] > rules.idle_timeout
            )
            if not closed:
                break
            done.append((begin, end))
            begin = end
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        rest = packets.iloc[begin:]
        if len(rest):
            self.held.put([tuple(r) for r in rest.itertuples(index=False, name=None)])
            due = ts[-1] if ready < len(ts) else ts[-1] + rules.idle_timeout
            self.handle.registerTimer(max(int(due), watermark) // 1000 + 1)
        else:
            self.held.clear()
        for first, last in done:
            flow = packets.iloc[first:last]
            # A stream cannot number the packets of a key, so the first packet's id names the flow.
            yield flow.assign(flow_key=key[0], flow_pos=int(flow.packet_id.iloc[0]), packet_no=range(last - first))[OUTPUT.fieldNames()]

    def close(self):
        pass


def closed_flow_packets(packets: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """The packets of every flow as it closes, as the batch segmentation would give them."""
    keyed = with_flow_key(keep_tcp_udp(packets)).withColumn("closes", is_closing_packet()).select(
        "flow_key", "ts", *ENDPOINTS, "ts_us", "packet_id", "closes", "is_forward", *MEASURES)
    return keyed.groupBy("flow_key").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(rules), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def remaining_flow_packets(spark: SparkSession, checkpoint: str, rules: FlowRules = FlowRules()) -> DataFrame:
    """The packets of all flows that a finished query left open, in the shape of `closed_flow_packets`.

    What the state holds of a key begins where a flow begins, so the batch segmentation continues it exactly, hot keys
    included. For use at the end of the input: a query that is started again from the checkpoint would close the same flows.
    A query that stopped before its first batch has no state and leaves nothing.
    """
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    packets = held.select("list_element.*").withColumns({
        "src_ip": _sender("lo_ip", "hi_ip"), "src_port": _sender("lo_port", "hi_port"),
        "dst_ip": _sender("hi_ip", "lo_ip"), "dst_port": _sender("hi_port", "lo_port")})
    names = [n.split()[0] for n in PACKET_SCHEMA.split(", ")]
    first = W.partitionBy(*FLOW).orderBy("packet_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return segment(packets.select(*names), rules).withColumn("_first", F.first("packet_id").over(first)).withColumn(
        "flow_pos", F.col("_first")).select(*OUTPUT.fieldNames())


def _sender(lo: str, hi: str):
    return F.when(F.col("is_forward"), F.col(lo)).otherwise(F.col(hi))


def _log(batch: DataFrame, batch_id: int | str, rules: FlowRules, model: PipelineModel, mapping: DataFrame, log_root: str,
         features: list[str], callback: Callable[[DataFrame], None] | None) -> None:
    scored = workflows.score_flows(batch, rules, model, mapping).persist()
    # The folder of a batch is overwritten when the batch is repeated after a failure.
    sinks.flow_log_rows(scored, list(features)).write.mode("overwrite").json(f"{log_root}/flows/batch={batch_id}")
    alerts.attack_log(scored).write.mode("overwrite").json(f"{log_root}/attacks/batch={batch_id}")
    alerts.block_list(scored, key="flow_key").write.mode("overwrite").json(f"{log_root}/blocks/batch={batch_id}")
    alerts.verdict_counts(scored).write.mode("overwrite").json(f"{log_root}/counts/batch={batch_id}")
    if callback is not None:
        alerts.on_attack(callback)(scored, batch_id)
    scored.unpersist()


def start_detection(packets: DataFrame, model: PipelineModel, mapping: DataFrame, log_root: str, checkpoint: str,
                    rules: FlowRules = FlowRules(), features: list[str] = (),
                    callback: Callable[[DataFrame], None] | None = None, trigger: dict | None = None):
    """Packets in, scored flows out: flow log, attack log, block list, counts, and an optional function of each alert table."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _log(batch, batch_id, rules, model, mapping, log_root, features, callback)

    return (
        closed_flow_packets(packets, rules).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def finish_detection(spark: SparkSession, model: PipelineModel, mapping: DataFrame, log_root: str, checkpoint: str,
                     rules: FlowRules = FlowRules(), features: list[str] = (),
                     callback: Callable[[DataFrame], None] | None = None) -> None:
    """Score and log the flows that were open when the input ended; call it once the query has stopped. Repeats overwrite."""
    _log(remaining_flow_packets(spark, checkpoint, rules), "last", rules, model, mapping, log_root, features, callback)


def session_so_far(spark: SparkSession, log_root: str) -> DataFrame:
    """One row of running totals from the logs: packets, bytes, flows, attacks, benign flows, covered time."""
    return alerts.total_verdicts(spark.read.schema(alerts.COUNTS).json(f"{log_root}/counts"))


def blocked_so_far(spark: SparkSession, log_root: str) -> DataFrame:
    """`(ip, blocked_us, reason)`: every blocked address once, with its first alert."""
    rows = spark.read.schema(alerts.BLOCKS).json(f"{log_root}/blocks")
    return rows.groupBy("ip").agg(F.min("blocked_us").alias("blocked_us"), F.min_by("reason", F.struct("blocked_us", "reason")).alias("reason"))
