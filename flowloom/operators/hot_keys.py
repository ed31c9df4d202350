"""Flow segmentation for keys too large for one task.

Where a flow ends depends only on where it begins, and a flow spans at most
`max_packets` packets. So a hot key is cut into chunks of consecutive packets,
and each chunk, given the packets that follow it, is summarised by a short
table: "entered at offset e, the first flow beginning in the next chunk begins
at offset exits[e]", for e below `max_packets`. These tables compose, so the
entry offset of every chunk follows from a tree of bounded groups, and then all
chunks are segmented at once. The result equals a single pass over the key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from ..functions.ranks import with_position
from . import flows

FAN_IN = 512
#: Packets that a task summarises at once.
AT_ONCE = 200_000
KEYS = ["flow_key", "chunk"]


def next_starts(ts: np.ndarray, closes: np.ndarray, rules: flows.FlowRules, ends: np.ndarray | None = None,
                timed: np.ndarray | None = None) -> np.ndarray:
    """For each position of sorted packet runs, where the flow after the one beginning there begins.

    `ends` gives the end of each position's run (by default all are one run); runs lie one after the other. Packets
    where `timed` is false have no time: they come first in a run and no gap or limit of time holds for them.
    """
    n = len(ts)
    at = np.arange(n)
    ends = np.full(n, n) if ends is None else ends
    timed = np.ones(n, bool) if timed is None else timed
    last = np.minimum(at + rules.max_packets - 1, ends)
    # How many packets lie up to each limit: packets and limits in one order, packets first where they are equal.
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    spots = np.concatenate([np.where(timed, ts, lowest), np.where(timed, ts + rules.active_timeout, highest)])
    order = np.lexsort((np.repeat([0, 1], n), spots, np.tile(ends, 2)))
    within = np.empty(2 * n, np.int64)
    within[order] = np.cumsum(order < n)
    last = np.minimum(last, within[n:])
    flagged = np.minimum(np.minimum.accumulate(np.where(closes, at, n)[::-1])[::-1], ends)
    last = np.minimum(last, np.maximum(flagged, at + rules.min_closing_packets - 1))
    gap_after = np.append((np.diff(ts) > rules.idle_timeout) & timed[:-1], True) | (at + 1 == ends)
    next_gap = np.minimum.accumulate(np.where(gap_after, at + 1, n)[::-1])[::-1]
    return np.minimum(np.minimum(last + 1, next_gap), ends)


def _chunk_starts(packets: pa.Table) -> np.ndarray:
    fresh = np.ones(packets.num_rows, bool)
    key, chunk = packets.column("flow_key"), packets.column("chunk").to_numpy()
    fresh[1:] = (chunk[1:] != chunk[:-1]) | pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()
    return np.flatnonzero(fresh)


def _exits_of(packets: pa.Table, starts: np.ndarray, rules: flows.FlowRules, chunk_packets: int) -> pa.RecordBatch:
    """The exit tables of whole chunks that lie one after the other, all at once."""
    n = packets.num_rows
    lengths = np.diff(np.append(starts, n))
    number = np.repeat(np.arange(len(starts)), lengths)
    sizes = np.minimum(lengths, chunk_packets)
    ts = packets.column("ts_us")
    jump = next_starts(ts.fill_null(0).to_numpy(), packets.column("closes").fill_null(False).to_numpy(), rules,
                       np.repeat(starts + lengths, lengths), ts.is_valid().to_numpy())
    # Every chunk gets a place behind its last packet. Where a flow begins in the next chunk, the walk stands still.
    first = starts + np.arange(len(starts))
    walk = np.arange(n + len(starts))
    inside = np.arange(n) - starts[number] < sizes[number]
    at = np.arange(n) + number
    walk[at[inside]] = (jump + number)[inside]
    entries = np.minimum(sizes, rules.max_packets)
    offsets = np.concatenate([[0], np.cumsum(entries)])
    owner = np.repeat(np.arange(len(starts)), entries)
    entered = first[owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    bound = (first + sizes)[owner]
    while (walk[entered] < bound).any():  # pointer doubling
        walk = walk[walk]
    exits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((walk[entered] - bound).astype(np.int32)))
    heads = packets.select(KEYS).take(pa.array(starts)).combine_chunks()
    return pa.record_batch([*[heads.column(k).combine_chunks() for k in KEYS], exits], [*KEYS, "exits"])


def _exit_tables(rules: flows.FlowRules, chunk_packets: int, at_once: int = AT_ONCE):
    """For packets sorted by chunk and position; a task holds `at_once` of them, or twice a longer chunk."""
    def exits(batches):
        held, rows, enough = [], 0, at_once
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            packets = pa.Table.from_batches(held)
            starts = _chunk_starts(packets)
            if cut := int(starts[-1]):  # the last chunk may go on
                yield _exits_of(packets.slice(0, cut), starts[:-1], rules, chunk_packets)
            held = packets.slice(cut).to_batches()
            rows -= cut
            enough = max(at_once, 2 * rows)
        if rows:
            packets = pa.Table.from_batches(held)
            yield _exits_of(packets, _chunk_starts(packets), rules, chunk_packets)

    return exits


def chunk_entries(tables: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """`(flow_key, chunk, exits)` to `(flow_key, chunk, entry)`; a key enters its chunk 0 at 0."""
    parent = tables.groupBy("flow_key", F.expr(f"chunk div {fan_in}").alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "exits"))).alias("children"))  # at most fan_in tables

    def follow(exits, entry):
        # Only the last chunk of a key can be shorter than its entry; nothing reads its exit.
        return F.coalesce(F.get(exits, entry), F.lit(0))

    if chunks <= fan_in:
        entered = parent.withColumn("entry", F.lit(0))
    else:
        composed = parent.select(
            "flow_key", F.col("parent").alias("chunk"),
            F.aggregate(
                F.slice("children", F.lit(2), F.size("children")), F.col("children")[0]["exits"],
                lambda acc, child: F.transform(acc, lambda e: follow(child["exits"], e)),
            ).alias("exits"))
        above = chunk_entries(composed, math.ceil(chunks / fan_in), fan_in).withColumnRenamed("chunk", "parent")
        entered = parent.join(above, ["flow_key", "parent"])

    scanned = F.aggregate(
        "children",
        F.struct(F.col("entry").cast("int").alias("entry"),
                 F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("seen")),
        lambda acc, child: F.struct(
            follow(child["exits"], acc["entry"]).alias("entry"),
            F.concat(acc["seen"], F.array(F.struct(child["chunk"].alias("chunk"), acc["entry"].alias("entry"))))
            .alias("seen")),
        lambda acc: acc["seen"],
    )
    return entered.select("flow_key", F.inline(scanned))


def segment_hot(keyed: DataFrame, rules: flows.FlowRules, carry: list[str], chunk_packets: int | None = None,
                fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """Same rows and columns as the ordinary segmentation, with every task bounded."""
    chunk_packets = max(chunk_packets or rules.chunk_packets, rules.max_packets)
    needed = dict.fromkeys(["flow_key", *flows.ENDPOINTS, "ts_us", "packet_id", "tcp_flags", "is_forward", *carry])
    ranked = with_position(keyed.select(*needed), ["flow_key"], ["ts_us", "packet_id"], "rank", partitions)
    own = F.expr(f"rank div {chunk_packets}")
    # The first max_packets packets of a chunk also close flows begun in the chunk before it.
    shared = (F.col("rank") % chunk_packets < rules.max_packets) & (own > 0)
    spread = ranked.withColumn(
        "chunk", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own)))
    ).withColumn("pos", (F.col("rank") - F.col("chunk") * chunk_packets).cast("int"))

    tables = stabilise(
        spread.select(*KEYS, "pos", "ts_us", flows.is_closing_packet().alias("closes"))
        .repartition(*KEYS).sortWithinPartitions(*KEYS, "pos").mapInArrow(
            _exit_tables(rules, chunk_packets), "flow_key string, chunk bigint, exits array<int>"))
    chunks = tables.agg(F.max("chunk")).first()[0]
    entries = chunk_entries(tables, (chunks or 0) + 1, fan_in)

    grouped = flows.gather(spread, KEYS, carry).join(entries, KEYS)
    # Packets past the last flow that begins in this chunk belong to the next chunk's flows.
    cut = grouped.withColumn("all_starts", flows.flow_starts("packets", rules, "entry"))
    cut = cut.withColumn("starts", F.filter("all_starts", lambda s: s < chunk_packets)).withColumn(
        "stop", F.coalesce(F.get("all_starts", F.size("starts")), F.size("packets")))
    cut = cut.withColumn("packets", F.slice("packets", F.lit(1), F.col("stop")))
    return flows.split_into_flows(
        cut, KEYS, F.col("starts"), F.col("begin") + F.col("chunk") * chunk_packets
    ).where("packet_id is not null").drop("chunk")  # a flow may cover the whole short last chunk of a key
