import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, packet, walk
from pyspark.sql import functions as F

from flowloom.constants import FEATURES
from flowloom.operators import flow_features, flows, hot_keys
from flowloom.operators.flows import SECOND, FlowRules


def positions(segmented):
    return {r.packet_id: r.flow_pos for r in segmented.select("packet_id", "flow_pos").collect()}


def test_key_orders_addresses_as_strings(spark):
    rows = [(1, 0, "10.0.0.9", "10.0.0.10", 5, 5, 6, 40, 0, 40, 0, 0), (2, 0, "1.1.1.1", "1.1.1.1", 7, 7, 6, 40, 0, 40, 0, 0)]
    got = flows.with_flow_key(frame(spark, rows)).orderBy("packet_id").collect()
    assert got[0].flow_key == "10.0.0.10:5-10.0.0.9:5-6" and not got[0].is_forward
    assert not got[1].is_forward


def test_both_directions_share_a_key(spark):
    rows = [packet(1, 0), packet(2, 1, fwd=False)]
    got = flows.with_flow_key(frame(spark, rows)).orderBy("packet_id").collect()
    assert got[0].flow_key == got[1].flow_key and got[0].is_forward and not got[1].is_forward


@pytest.mark.parametrize("packets, expected", [
    # The 500th packet closes its flow and belongs to it.
    ([packet(i, i * 0.001) for i in range(501)], {499: 0, 500: 500}),
    # Exactly 30 s does not close, one microsecond more does.
    ([packet(0, 0), packet(1, 30.0), packet(2, 30.1)], {2: 0}),
    ([packet(0, 0), packet(1, 30.000001), packet(2, 30.1)], {1: 0, 2: 2}),
    # FIN at the second packet closes at the fourth.
    ([packet(i, i, flags=17 if i == 1 else 16) for i in range(6)], {3: 0, 4: 4, 5: 4}),
    # A gap of exactly 60 s stays, a microsecond more splits.
    ([packet(0, 0), packet(1, 60.0)], {1: 0}),
    ([packet(0, 0), packet(1, 60.000001)], {1: 1}),
])
def test_segmentation_limits(spark, packets, expected):
    rules = FlowRules(active_timeout=10**15) if packets[-1][1] >= 60 * SECOND else FlowRules()
    got = positions(flows.segment(frame(spark, packets), rules))
    assert {k: got[k] for k in expected} == expected
    assert got == walk(packets, rules)


def _burst(n, seed, port=1):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.001, 0.5, 2.0, 7.0, 70.0]) * rng.random()
        out.append(packet(i + seed * 100_000, t, fwd=rng.random() < 0.5, length=rng.randint(40, 1500),
                          flags=rng.choice([16, 16, 16, 24, 17, 4, 2]), port=port))
    return out


RULES = FlowRules(max_packets=9, active_timeout=20 * SECOND, idle_timeout=30 * SECOND)


def test_long_key_crosses_fold_slices(spark):
    packets = _burst(5000, 1)
    assert positions(flows.segment(frame(spark, packets), RULES)) == walk(packets, RULES)


@pytest.mark.parametrize("chunk, fan_in", [(9, 2), (50, 3), (1000, 512), (10_000, 512)])
def test_chunked_hot_keys_equal_one_pass(spark, chunk, fan_in):
    one, two = _burst(3000, 2, port=1), _burst(700, 3, port=2)
    keyed = flows.with_flow_key(frame(spark, one + two))
    hot = hot_keys.segment_hot(keyed, RULES, flows.MEASURES, chunk_packets=chunk, fan_in=fan_in, partitions=9)
    assert hot.count() == 3700
    assert positions(hot) == {**walk(one, RULES), **walk(two, RULES)}


def test_hot_key_with_equal_times_only(spark):
    packets = [packet(i, 5.0) for i in range(500)]
    keyed = flows.with_flow_key(frame(spark, packets))
    hot = hot_keys.segment_hot(keyed, RULES, [], chunk_packets=20, fan_in=2, partitions=10)
    assert positions(hot) == walk(packets, RULES)


def test_many_small_chunks_are_summarised_together():
    rng, rows = np.random.default_rng(7), []
    for key, chunk, n in [("a", c, 12) for c in range(30)] + [("b", 0, 3), ("c", 0, 1), ("c", 1, 40)]:
        ts = np.cumsum(rng.choice([0, 1, 8, 40], n)) * SECOND
        rows += [(key, chunk, None if key == "b" and i == 0 else int(t), bool(rng.random() < 0.2)) for i, t in enumerate(ts)]
    table = pa.table(list(zip(*rows)), pa.schema([
        ("flow_key", pa.string()), ("chunk", pa.int64()), ("ts_us", pa.int64()), ("closes", pa.bool_())]))
    got = list(hot_keys._exit_tables(RULES, 10, at_once=100)(table.to_batches(max_chunksize=7)))
    assert len(got) < 7  # not a call for each of the 33 chunks
    found = {(r["flow_key"], r["chunk"]): r["exits"] for b in got for r in b.to_pylist()}
    expected = {}
    for key, chunk in dict.fromkeys(r[:2] for r in rows):
        own = [r for r in rows if r[:2] == (key, chunk)]
        packets = [(i, t, c) for i, (_, _, t, c) in enumerate(own)]
        size, exits = min(10, len(own)), []
        for at in range(min(size, RULES.max_packets)):
            while at < size:
                n, closing, start = 0, False, packets[at][1]
                while True:
                    _, t, closes = packets[at]
                    n, closing, at = n + 1, closing or closes, at + 1
                    late = None not in (t, start) and t - start > RULES.active_timeout
                    if at == len(packets) or n >= RULES.max_packets or late or (closing and n >= RULES.min_closing_packets):
                        break
                    if None not in (t, packets[at][1]) and packets[at][1] - t > RULES.idle_timeout:
                        break
            exits.append(at - size)
        expected[key, chunk] = exits
    assert found == expected


def test_heavy_keys_take_the_chunked_way(spark):
    import dataclasses

    packets = _burst(400, 4, port=1) + _burst(30, 5, port=2)
    rules = dataclasses.replace(RULES, hot_key_packets=100)
    df = frame(spark, packets)
    a, b = flows.segment(df, rules), flows.segment(df, RULES)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count() == 430


def test_flow_features_of_a_small_flow(spark):
    rows = [packet(1, 0.0, True, 100), packet(2, 0.5, False, 200), packet(3, 2.0, True, 300), packet(4, 2.5, False, 400)]
    got = flow_features.flow_features(frame(spark, rows)).first().asDict()
    expected = {
        "Flow Duration": 2_500_000, "Fwd IAT Mean": 2_000_000, "Bwd IAT Mean": 2_000_000, "Flow IAT Mean": 2_000_000,
        "Flow IAT Std": 0, "Fwd Packet Length Mean": 200, "Fwd Packet Length Std": 100, "Packet Length Mean": 250,
        "Packet Length Variance": 12_500, "Down/Up Ratio": 1.0, "Flow Bytes/s": 400, "Idle Mean": 1_500_000,
        "Active Mean": 500_000, "Active Std": 0, "act_data_pkt_fwd": 2, "min_seg_size_forward": 100,
        "ACK Flag Count": 4, "Fwd Header Length": 80, "Fwd Header Length.1": 80, "Init_Win_bytes_forward": 1000,
    }
    assert {k: got[k] for k in expected} == expected
    assert [n for n in got if n in set(FEATURES)] == FEATURES and len(FEATURES) == 77


def test_single_packet_flow(spark):
    got = flow_features.flow_features(frame(spark, [packet(1, 3.0, window=0)])).first().asDict()
    assert got["Flow Duration"] == 1 and got["Flow Packets/s"] == 1_000_000
    assert got["Init_Win_bytes_forward"] == got["Init_Win_bytes_backward"] == 65535
    assert all(got[n] == 0 for n in FEATURES if "IAT" in n or "Active" in n or "Idle" in n or n.endswith("Std"))


def test_idle_sessions(spark):
    rows = [packet(1, 0.0), packet(2, 60.0), packet(3, 120.000001), packet(4, 500.0)]
    got = flows.idle_sessions(frame(spark, rows)).orderBy("start_us").collect()
    assert [r.packets for r in got] == [2, 1, 1]


def test_flow_counters_and_conservation(spark):
    packets = _burst(1000, 6)
    segmented = flows.segment(frame(spark, packets), RULES)
    c = flows.flow_counters(segmented, RULES).first()
    assert c.total_packets == 1000 and c.flows_created == len(set(walk(packets, RULES).values()))
    assert c.flows_completed + c.active_flows == c.flows_created
    assert flows.flow_base(segmented).agg(F.sum("packets")).first()[0] == 1000


def test_sanitised_and_warnings(spark):
    df = spark.createDataFrame([(float("nan"), -1.0), (float("inf"), 2.0)], ["Flow Duration", "Down/Up Ratio"])
    names = ["Flow Duration", "Down/Up Ratio"]
    warned = {r.feature: (r.invalid, r.negative) for r in flow_features.sanity_warnings(df, names).collect()}
    assert warned == {"Flow Duration": (2, 0), "Down/Up Ratio": (0, 0)}
    assert [r[0] for r in flow_features.sanitised(df, names).collect()] == [0.0, 0.0]


def test_one_shuffle_from_packets_to_features(spark, sf):
    from flowloom.plans.packet_queries import RULES as scaled
    from flowloom.sources.bindings import spark_view

    plan = flow_features.flow_features(spark_view(spark, sf, "packets"), scaled)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1
    assert "PythonUDF" not in physical and "MapInPandas" not in physical


def test_segmentation_reads_only_what_it_needs(spark, sf):
    import __spark_entry__ as entry

    physical = entry.queries()["flow_segments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = physical.split("ReadSchema: ")[1].split("\n")[0]
    assert "value" not in schema and "user_id" in schema
