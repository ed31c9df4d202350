"""Packets to bidirectional flows.

A packet table has the columns `packet_id, ts_us, src_ip, dst_ip, src_port,
dst_port, protocol, header_len, payload_len, packet_len, tcp_flags,
window_size`; `ts_us` is the epoch time in microseconds.

A flow is identified by `(flow_key, flow_pos)`, where `flow_pos` is the position
of its first packet among all packets of the key in `(ts_us, packet_id)` order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FLAG_FEATURES, TCP, TCP_FLAG_BITS, UDP
from ..functions.bounded import pin_small

FLOW = ["flow_key", "flow_pos"]
ENDPOINTS = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
MEASURES = ["header_len", "payload_len", "packet_len", "tcp_flags", "window_size"]
SECOND = 1_000_000


@dataclass(frozen=True)
class FlowRules:
    """When a flow ends. Times are microseconds."""

    idle_timeout: int = 60 * SECOND
    active_timeout: int = 30 * SECOND
    max_packets: int = 500
    min_closing_packets: int = 4
    idle_threshold: int = 1 * SECOND
    # Keys with more packets than this are cut into chunks (see hot_keys).
    hot_key_packets: int = 1_000_000
    chunk_packets: int = 100_000


def keep_tcp_udp(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("protocol").isin(TCP, UDP))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the orientation-free key, its two endpoints and the packet direction.

    Addresses compare as strings and ports as numbers; equal endpoints are backward.
    """
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    forward = src < dst

    def side(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    return (
        packets
        .withColumns({
            "is_forward": forward,
            "lo_ip": side("src_ip", "dst_ip"), "lo_port": side("src_port", "dst_port"),
            "hi_ip": side("dst_ip", "src_ip"), "hi_port": side("dst_port", "src_port"),
        })
        .withColumn("flow_key", F.concat_ws(
            "-", F.concat_ws(":", "lo_ip", "lo_port"), F.concat_ws(":", "hi_ip", "hi_port"), "protocol"))
    )


def is_closing_packet() -> Column:
    """FIN or RST set."""
    return F.col("tcp_flags").bitwiseAND(TCP_FLAG_BITS["FIN"] | TCP_FLAG_BITS["RST"]) != 0


# --------------------------------------------------------------------------- segmentation

SLICE = 1024  # packets folded between two appends to the outer result


def flow_starts(packets: str, rules: FlowRules, first: str = "0") -> Column:
    """Positions in the sorted packet array column at which a new flow begins, from `first` on.

    A fold carrying the open flow: its packet count, its start, the last time seen and
    whether a closing flag was seen. The packet that reaches a limit still belongs to the
    flow; a gap above the idle timeout begins a new one. The array is folded in slices so
    that the growing result is copied once per slice and not once per flow.
    """
    fresh = f"(s.n = 0 or p.ts_us - s.last > {rules.idle_timeout}L)"
    n = f"if({fresh}, 1, s.n + 1)"
    start = f"if({fresh}, p.ts_us, s.start)"
    closing = f"(p.closes or (s.closing and not {fresh}))"
    done = (f"({n} >= {rules.max_packets} or p.ts_us - {start} > {rules.active_timeout}L "
            f"or ({closing} and {n} >= {rules.min_closing_packets}))")

    def state(of: str, starts: str) -> str:
        fields = ", ".join(f"'{f}', {of}.{f}" for f in ("at", "n", "start", "last", "closing"))
        return f"named_struct({fields}, 'starts', {starts})"

    one_slice = f"""aggregate(
        slice({packets}, cast({first} as int) + number * {SLICE} + 1, {SLICE}),
        {state('acc', 'cast(array() as array<int>)')},
        (s, p) -> named_struct(
            'at', s.at + 1, 'n', if({done}, 0, {n}), 'start', {start}, 'last', p.ts_us, 'closing', {closing},
            'starts', if({fresh}, concat(s.starts, array(s.at)), s.starts)),
        s -> {state('s', 'concat(acc.starts, array(s.starts))')})"""
    slices = f"sequence(0, cast(floor((size({packets}) - {first} - 1) / {SLICE}) as int))"
    return F.expr(f"""flatten(aggregate(
        if(size({packets}) > {first}, {slices}, cast(array() as array<int>)),
        named_struct('at', cast({first} as int), 'n', 0, 'start', 0L, 'last', 0L, 'closing', false,
                     'starts', cast(array() as array<array<int>>)),
        (acc, number) -> {one_slice},
        acc -> acc.starts))""")


def split_into_flows(grouped: DataFrame, keys: list[str], starts: Column, flow_pos: Column) -> DataFrame:
    """Rows `(keys, endpoints, packets)` and the flow start positions to one row per packet."""
    # Each flow takes its own slice before the explode, so no row carries the whole array.
    # The outer variants: no array is empty here, and the inner ones would make the
    # optimizer add a non-empty filter that evaluates the fold a second time.
    cut = """transform(starts, (b, i) -> named_struct(
        'begin', b, 'packets', slice(packets, b + 1, coalesce(get(starts, i + 1), size(packets)) - b)))"""
    flows = grouped.withColumn("starts", starts).select(
        *keys, *ENDPOINTS, F.explode_outer(F.expr(cut)).alias("flow")
    ).select(*keys, *ENDPOINTS, F.col("flow.begin").alias("begin"), F.col("flow.packets").alias("flow_packets"))
    return flows.select(
        *keys, flow_pos.alias("flow_pos"), *ENDPOINTS, F.posexplode_outer("flow_packets").alias("packet_no", "packet")
    ).select(*keys, "flow_pos", *ENDPOINTS, "packet_no", "packet.*")


def gather(keyed: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One row per group: the endpoints, and the packets as a time-ordered array of structs."""
    packet = F.struct("ts_us", "packet_id", is_closing_packet().alias("closes"), "is_forward", *carry)
    return keyed.groupBy(*keys).agg(
        *[F.first(n).alias(n) for n in ENDPOINTS],  # constant inside a key
        F.sort_array(F.collect_list(packet)).alias("packets"))


def segment(packets: DataFrame, rules: FlowRules = FlowRules(), carry: list[str] | None = None) -> DataFrame:
    """Assign every TCP or UDP packet to its flow; others belong to none.

    The result has `flow_key, flow_pos`, the endpoints, `packet_no` (position in the
    flow), `ts_us, packet_id, closes, is_forward` and the `carry` columns (by default
    all packet measures).

    Keys of ordinary size are grouped once and folded inside the JVM, and the
    result stays partitioned by `flow_key`, so per-flow work needs no further
    shuffle. Keys above `rules.hot_key_packets` (found by a counting pass) take
    the chunked way in `hot_keys`, which never puts a whole key into one task.
    """
    from . import hot_keys

    carry = MEASURES if carry is None else carry
    keyed = with_flow_key(keep_tcp_udp(packets))
    heavy, rows = pin_small(
        keyed.groupBy("flow_key").agg(F.count("*").alias("n")).where(F.col("n") > rules.hot_key_packets))
    if rows == []:
        return _segment_ordinary(keyed, rules, carry)
    cold = keyed.join(heavy.select("flow_key"), "flow_key", "left_anti")
    hot = keyed.join(heavy.select("flow_key"), "flow_key", "left_semi")
    ordinary = _segment_ordinary(cold, rules, carry)
    return ordinary.unionByName(hot_keys.segment_hot(hot, rules, carry))


def _segment_ordinary(keyed: DataFrame, rules: FlowRules, carry: list[str]) -> DataFrame:
    grouped = gather(keyed, ["flow_key"], carry)
    return split_into_flows(grouped, ["flow_key"], flow_starts("packets", rules), F.col("begin").cast("long"))


# --------------------------------------------------------------------------- per-packet timing

def with_timing(segmented: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """Add `iat_us` (gap within the same direction), `gap_us` (gap within the flow),
    `idle_us` and `active_us` (length of an idle or active period ending here).

    One window per flow serves every column. An active period ends where a gap
    exceeds the idle threshold, and at the last packet; zero-length ones vanish.
    """
    w = W.partitionBy(*FLOW).orderBy("packet_no")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ts = F.col("ts_us")
    gap = ts - F.lag("ts_us").over(w)
    base = segmented.withColumns({
        "gap_us": gap,
        "prev_fwd": F.last(F.when(F.col("is_forward"), ts), ignorenulls=True).over(earlier),
        "prev_bwd": F.last(F.when(~F.col("is_forward"), ts), ignorenulls=True).over(earlier),
        "is_last": F.lead("ts_us").over(w).isNull(),
    })
    breaks = F.col("gap_us") > rules.idle_threshold
    opens = F.when(F.col("gap_us").isNull() | breaks, ts)
    base = base.withColumns({
        "period_start": F.last(opens, ignorenulls=True).over(so_far),
        "prev_period_start": F.last(opens, ignorenulls=True).over(earlier),
    })
    active = F.when(breaks, ts - F.col("gap_us") - F.col("prev_period_start")).when(
        F.col("is_last"), ts - F.col("period_start"))
    return base.withColumns({
        "iat_us": ts - F.when(F.col("is_forward"), F.col("prev_fwd")).otherwise(F.col("prev_bwd")),
        "idle_us": F.when(breaks, F.col("gap_us")),
        "active_us": F.when(active > 0, active),
    }).drop("prev_fwd", "prev_bwd", "is_last", "period_start", "prev_period_start")


def active_idle_periods(segmented: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """Active and idle period statistics per flow."""
    timed = with_timing(segmented, rules)
    return timed.groupBy(*FLOW).agg(
        F.count("active_us").alias("active_periods"), F.coalesce(F.sum("active_us"), F.lit(0)).alias("active_us"),
        F.count("idle_us").alias("idle_periods"), F.coalesce(F.sum("idle_us"), F.lit(0)).alias("idle_us"),
    )


# --------------------------------------------------------------------------- per-flow aggregates

SIDES = {"fwd": "is_forward", "bwd": "not is_forward"}


def base_aggregates() -> list[str]:
    out = [
        "min(ts_us) as start_us", "max(ts_us) as last_us", "count(*) as packets",
        "sum(cast(packet_len as bigint)) as bytes", "min_by(is_forward, packet_no) as initiator_is_lo",
    ]
    for name, side in SIDES.items():
        out += [
            f"count_if({side}) as {name}_packets",
            f"sum(cast(if({side}, packet_len, 0) as bigint)) as {name}_bytes",
            f"sum(cast(if({side}, header_len, 0) as bigint)) as {name}_header_bytes",
        ]
    return out


def per_flow(segmented: DataFrame, aggregates: list[str], in_order: bool = False) -> DataFrame:
    """Aggregates per flow, with its endpoints, initiator and duration (at least 1 microsecond).

    The endpoints are constant inside a flow. As grouping columns they let Spark hash.
    Rows that already lie in flow order (`in_order`, after a window over flows) are better
    aggregated as they come: text among the aggregates makes Spark do that, with no hash
    table to fill and no further sort.
    """
    keys, firsts = (FLOW, [f"first({n}) as {n}" for n in ENDPOINTS]) if in_order else ([*FLOW, *ENDPOINTS], [])
    return segmented.groupBy(*keys).agg(*map(F.expr, [*firsts, *base_aggregates(), *aggregates])).selectExpr(
        "*", "if(initiator_is_lo, lo_ip, hi_ip) as initiator_ip", "greatest(last_us - start_us, 1) as duration_us"
    ).drop("initiator_is_lo")


def flow_base(segmented: DataFrame) -> DataFrame:
    """Packets, bytes, header bytes, start, last and duration per flow."""
    return per_flow(segmented, []).drop(*ENDPOINTS)


def flag_aggregates() -> list[str]:
    def has(flag: str) -> str:
        return f"(tcp_flags & {TCP_FLAG_BITS[flag]}) <> 0"

    out = [f"count_if({has(flag)}) as `{feature}`" for feature, flag in FLAG_FEATURES.items()]
    for flag in ("PSH", "URG"):
        out += [f"count_if({has(flag)} and {side}) as `{name.capitalize()} {flag} Flags`" for name, side in SIDES.items()]
    return out


def flow_flags(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*FLOW).agg(*map(F.expr, flag_aggregates()))


def window_aggregates() -> list[str]:
    return [f"min_by(window_size, if({side} and window_size is not null, packet_no, null)) as init_win_{name}"
            for name, side in SIDES.items()]


def flow_init_window(segmented: DataFrame) -> DataFrame:
    """Window size of the first packet of each direction, NULL without packets."""
    return segmented.groupBy(*FLOW).agg(*map(F.expr, window_aggregates()))


def flow_counters(segmented: DataFrame, rules: FlowRules = FlowRules()) -> DataFrame:
    """Packets processed; flows created, completed by a closing packet, and still open at the end.

    A flow counts as completed when its own packets met a limit, or when a later
    flow of the same key shows that it had gone idle.
    """
    per_flow = segmented.groupBy(*FLOW).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"),
        F.max("closes").alias("closing"),
    )
    per_key = per_flow.groupBy("flow_key").agg(
        F.count("*").alias("flows"), F.sum("n").alias("packets"),
        F.max_by(
            (F.col("n") >= rules.max_packets)
            | (F.col("last_us") - F.col("start_us") > rules.active_timeout)
            | (F.col("closing") & (F.col("n") >= rules.min_closing_packets)), "flow_pos").alias("last_closed"),
    )
    return per_key.agg(
        F.sum("packets").alias("total_packets"), F.sum("flows").alias("flows_created"),
        (F.sum("flows") - F.count_if(~F.col("last_closed"))).alias("flows_completed"),
        F.count_if(~F.col("last_closed")).alias("active_flows"),
    )


# --------------------------------------------------------------------------- idle sessions

def idle_sessions(packets: DataFrame, timeout: int = 60 * SECOND) -> DataFrame:
    """TCP and UDP sessions of a key separated by gaps above `timeout` (a gap equal to it does not split).

    Packets closer than the timeout always share a session, so each key is first
    reduced to one row per timeout-wide bucket on the map side; only those rows,
    whose number depends on the covered time and not on the packets, are windowed.
    """
    buckets = with_flow_key(keep_tcp_udp(packets)).groupBy("flow_key", (F.col("ts_us") - F.pmod("ts_us", F.lit(timeout))).alias("bucket")).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count("*").alias("n"), F.sum(F.col("packet_len").cast("long")).alias("b"),
    )
    w = W.partitionBy("flow_key").orderBy("bucket")
    splits = F.col("first_us") - F.lag("last_us").over(w) > timeout
    numbered = buckets.withColumn("splits", F.coalesce(splits.cast("int"), F.lit(0))).withColumn(
        "session_no", F.sum("splits").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("flow_key", "session_no").agg(
        F.min("first_us").alias("start_us"), F.max("last_us").alias("last_us"),
        F.sum("n").alias("packets"), F.sum("b").alias("bytes"),
    )
