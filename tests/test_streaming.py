import pytest
from pyspark.sql import functions as F

from flowloom.constants import FEATURES
from flowloom.functions.columns import c
from flowloom.operators import alerts, flow_features, flows, labels, models
from flowloom.plans.packet_queries import RULES
from flowloom.sources.bindings import spark_view
from flowloom.streaming import flow_stream

PACKET = ["packet_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", *flows.MEASURES]


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """Packets landed in four files in time order."""
    root = str(tmp_path_factory.mktemp("landed"))
    packets = spark_view(spark, sf, "packets").select(*PACKET)
    bounds = packets.agg(F.percentile("ts_us", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))).first()[0]
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = packets.where(F.lit(low is None) | (F.col("ts_us") > F.lit(low)))
        part = part.where(F.lit(high is None) | (F.col("ts_us") <= F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(root)
    return root


def test_stream_equals_batch(spark, sf, landed, tmp_path):
    stream = flow_stream.packet_stream(spark, landed, delay="1 hour", files_per_trigger=1)
    query = (flow_stream.closed_flow_packets(stream, RULES).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    during = spark.read.parquet(str(tmp_path / "out"))
    left = flow_stream.remaining_flow_packets(spark, str(tmp_path / "cp"), RULES)
    assert during.count() > 0 and left.count() > 0
    closed = during.unionByName(left)
    batch = flows.segment(spark_view(spark, sf, "packets"), RULES)
    key = ["flow_key", "start_us", "last_us", "packets", "bytes", "fwd_packets", "initiator_ip"]
    a, b = flows.flow_base(batch).select(*key), flows.flow_base(closed).select(*key)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert closed.count() == batch.count() == closed.select("packet_id").distinct().count()
    # Flows are named alike on both ways: by their first packet.
    assert closed.where("packet_no = 0 and flow_pos <> packet_id").count() == 0


def test_streaming_detection(spark, sf, landed, tmp_path):
    names = ["Flow Duration", "Total Fwd Packets", "Packet Length Mean"]
    table = flow_features.flow_features(spark_view(spark, sf, "packets"), RULES).withColumn(
        "y", (c("Packet Length Mean") > 85).cast("int"))
    model = models.train(table, names, "y", models.random_forest(numTrees=3, maxDepth=3))
    mapping = spark.createDataFrame([("BENIGN", 0), ("ATTACK", 1)], "label string, code int")
    seen = []
    stream = flow_stream.packet_stream(spark, landed, delay="1 hour")
    flow_stream.start_detection(
        stream, model, mapping, str(tmp_path / "log"), str(tmp_path / "cp"), RULES, FEATURES[:3],
        callback=lambda found: seen.append(found.count())).awaitTermination()
    for _ in range(2):  # a repeat changes nothing
        repeated = []
        flow_stream.finish_detection(spark, model, mapping, str(tmp_path / "log"), str(tmp_path / "cp"), RULES, FEATURES[:3],
                                     callback=lambda found: repeated.append(found.count()))
    seen += repeated
    logged = spark.read.json(str(tmp_path / "log" / "flows"))
    attacks = spark.read.json(str(tmp_path / "log" / "attacks"))
    expected = labels.decode_labels(models.score(table, model), mapping)
    assert logged.count() == table.count()
    assert attacks.count() == expected.where("label = 'ATTACK'").count()
    assert sum(seen) == attacks.count() > 0
    total = flow_stream.session_so_far(spark, str(tmp_path / "log")).first()
    assert (total.flows_analyzed, total.attacks_detected) == (table.count(), attacks.count())
    traffic = flows.keep_tcp_udp(spark_view(spark, sf, "packets"))
    assert total.packets == traffic.count()
    # A thousand addresses are within what a sketch counts exactly.
    assert (total.unique_src_ips, total.unique_dst_ips) == tuple(traffic.agg(F.countDistinct("src_ip"), F.countDistinct("dst_ip")).first())
    wanted = alerts.block_list(expected.withColumns({"ts_us": F.col("start_us")}))
    blocked = flow_stream.blocked_so_far(spark, str(tmp_path / "log"))
    assert {(r.ip, r.blocked_us) for r in blocked.collect()} == {(r.ip, r.blocked_us) for r in wanted.collect()}


def test_distinct_addresses_add_up_across_batches(spark):
    def batch(first, n):
        return spark.range(first, first + n).selectExpr(
            "concat('10.0.', id div 256, '.', id % 256) src_ip", "concat('10.9.0.', id % 9) dst_ip", "1 packets", "2 bytes", "'BENIGN' label",
            "id ts_us", "1 duration_us")

    parts = [alerts.verdict_counts(batch(*b)) for b in ((0, 3000), (1000, 4000), (0, 0), (1000, 4000))]
    total = alerts.total_verdicts(parts[0].union(parts[1]).union(parts[2]).union(parts[3])).first()
    assert total.unique_dst_ips == 9 and abs(total.unique_src_ips - 5000) <= 100
    empty = alerts.total_verdicts(parts[0].limit(0)).first()
    assert (empty.unique_src_ips, empty.unique_dst_ips, empty.flows_analyzed) == (0, 0, 0)
