import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.constants import FEATURES
from flowloom.functions.columns import c
from flowloom.operators import alerts, clean, metrics, models, scorecard, timing
from flowloom.sources import captures, csv_flows, registries, sinks


def test_csv_with_repeated_and_padded_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        " Fwd Header Length, Flow Bytes/s,Fwd Header Length, Label\n1,Infinity,2,BENIGN\n3,NaN,4,DoS\n5,,6,BENIGN\n")
    (tmp_path / "a.csv").write_text("Flow Bytes/s,Label\nx,BENIGN\n 7.5 ,Bot\n")
    df = csv_flows.read_flow_csvs(spark, str(tmp_path))
    assert {"Fwd Header Length", "Flow Bytes/s", "Fwd Header Length.1", "Label", "source_file"} == set(df.columns)
    b = df.where("source_file = 'b.csv'").orderBy(c("Fwd Header Length")).collect()
    assert [r["Fwd Header Length.1"] for r in b] == [2.0, 4.0, 6.0]
    assert b[0]["Flow Bytes/s"] == float("inf") and b[2]["Flow Bytes/s"] is None
    cleaned = clean.clean(df.where("source_file = 'b.csv'"))
    assert sorted(r["Flow Bytes/s"] for r in cleaned.collect()) == [0.0, 0.0]
    a = df.where("source_file = 'a.csv'").collect()
    assert sorted((r["Flow Bytes/s"] is None, r["Label"]) for r in a) == [(False, "Bot"), (True, "BENIGN")]
    cells = csv_flows.header_cells(csv_flows.read_headers(spark, str(tmp_path)))
    problems = clean.column_contract(cells, ["Flow Bytes/s", "Fwd Header Length"]).collect()
    assert ("missing", "Fwd Header Length") in {(r.problem, r.name) for r in problems if r.file.endswith("a.csv")}
    assert ("out_of_order", "Flow Bytes/s") in {(r.problem, r.name) for r in problems if r.file.endswith("b.csv")}


def test_no_csv_files(spark, tmp_path):
    with pytest.raises(Exception):
        csv_flows.read_flow_csvs(spark, str(tmp_path / "none"))


def test_splits_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0, "train"), (2.0, 1, "val"), (3.0, 1, "test")], ["Flow Duration", "Label_Binary", "split"])
    path = str(tmp_path / "ready")
    csv_flows.write_model_ready(df, ["Flow Duration"], path)
    got = csv_flows.read_split(spark, path, "val")
    assert [tuple(r) for r in got.collect()] == [(2.0, 1)] and got.columns == ["Flow Duration", "target"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString()


def test_registries(spark, tmp_path):
    run = tmp_path / "models" / "xgboost" / "cv5"
    run.mkdir(parents=True)
    (run / "results_binary.json").write_text(json.dumps({
        "task": "binary", "validation_metrics": {"precision": 0.99, "recall": 0.98, "f1": 0.985},
        "train_time_seconds": 3.5, "best_params": {"max_depth": 3}, "version": {"n_iter": 10, "cv": 5}}, indent=1))
    got = registries.read_results(spark, str(tmp_path / "models")).first()
    assert (got.model_type, got.version_id, got.precision, got.train_seconds) == ("xgboost", "cv5", 0.99, 3.5)
    assert got.false_positive_rate is None and got.best_params == {"max_depth": "3"}

    tune = tmp_path / "tuning" / "xgboost"
    tune.mkdir(parents=True)
    for day in ("01", "02"):
        (tune / f"run_{day}.json").write_text(json.dumps({
            "task": "binary", "tuning_timestamp": f"2026-01-{day}", "best_score": 0.9,
            "search_config": {"n_iterations": 3, "cv_folds": 2}}, indent=1))
    best = scorecard.latest_config(registries.read_tuning(spark, str(tmp_path / "tuning")), "xgboost").first()
    assert best.file_name == "run_02.json" and best.cv_folds == 2

    logs = tmp_path / "timing"
    logs.mkdir()
    (logs / "t.json").write_text(json.dumps({
        "module": "prep", "session_id": "1", "start_timestamp": "2026", "total_duration_seconds": 8.0,
        "parameters": {"a": 1}, "operations": {"load": {"duration_seconds": 2.0, "extra_info": {}}, "_metrics": {"duration_seconds": 1}}}))
    share = timing.operation_share(registries.read_timing(spark, str(logs))).first()
    assert (share.operation, share.percent) == ("load", 25.0)


def test_day_catalogue(spark):
    df = spark.createDataFrame([("Monday-WorkingHours.pcap_ISCX.csv",), ("other.csv",)], ["source_file"])
    got = {r.source_file: r.day for r in registries.with_day(df).collect()}
    assert got == {"Monday-WorkingHours.pcap_ISCX.csv": "monday", "other.csv": None}
    assert registries.day_catalogue(spark).count() == 8


def test_artifacts_round_trip(spark, tmp_path):
    scaler = {"Flow Duration": (1.0, 2.0), "Flow Bytes/s": (0.5, 1.0)}
    table = spark.createDataFrame([("Flow Duration", 0.9)], "feature string, importance double")
    registries.save_artifacts(spark, str(tmp_path), scaler, ["Flow Bytes/s"], table, table)
    assert registries.load_scaler(spark, str(tmp_path)) == scaler
    assert registries.load_selected(spark, str(tmp_path)) == ["Flow Bytes/s"]


SCORED_DDL = ("ts_us bigint, flow_key string, prediction int, label string, confidence double, src_ip string, dst_ip string, "
              "src_port int, dst_port int, protocol int, packets bigint, bytes bigint, duration_us bigint, x double")


def test_logs_and_block_list(spark, tmp_path):
    df = spark.createDataFrame([
        (2, "k1", 1, "Bot", 0.9, "1.2.3.4", "d", 1, 2, 6, 3, 4, 5, 0.5),
        (1, "k2", 1, "DoS", 0.8, "1.2.3.4", "d", 1, 2, 6, 3, 4, 5, 0.5),
        (0, "k3", 1, "DoS", 0.6, "1.2.3.4", "d", 1, 2, 6, 3, 4, 5, 0.5),
        (0, "k4", 0, "BENIGN", 0.9, "9.9.9.9", "d", 1, 2, 6, 3, 4, 5, 0.5),
        (0, "k5", 1, "DoS", 0.9, "not-an-address", "d", 1, 2, 6, 3, 4, 5, 0.5)], SCORED_DDL)
    assert [tuple(r) for r in alerts.block_list(df).collect()] == [("1.2.3.4", 1, "DoS")]
    sinks.write_flow_log(df, ["x"], str(tmp_path / "flows"))
    sinks.write_attack_log(df, str(tmp_path / "attacks"))
    assert spark.read.json(str(tmp_path / "flows")).select("features.x").distinct().first().x == 0.5
    log = spark.read.json(str(tmp_path / "attacks"))
    assert log.count() == 4 and "duration_us" in log.columns
    seen = []
    alerts.on_attack(lambda a: seen.append(a.count()))(df)
    assert seen == [4]


def test_report_and_model_versions(spark, tmp_path):
    data = spark.createDataFrame([(float(i), float(i % 7), int(i > 50)) for i in range(100)], "a double, b double, y int")
    model = models.train(data, ["a", "b"], "y", models.random_forest(numTrees=3, maxDepth=3))
    scored = models.score(data, model)
    assert scored.agg(F.min("confidence")).first()[0] >= 0.5 and "features" not in scored.columns
    report = metrics.binary_metrics(scored.select(F.col("y").alias("y_true"), F.col("prediction").alias("y_pred")))
    sinks.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().accuracy > 0.9
    root = str(tmp_path / "store")
    models.save_version(model, root, "random_forest", "v1", {"f1": 0.9, "features": ["a", "b"], "tuning_source": "t.json"})
    models.save_version(model, root, "random_forest", "v2", {"f1": 0.95, "features": ["a", "b"]})
    assert scorecard.best_version(spark.read.parquet(f"{root}/registry")).first().version_id == "v2"
    again = models.score(data, models.load_version(root, "random_forest", "v1"))
    assert again.select("prediction").exceptAll(scored.select("prediction")).count() == 0


def test_a_tuning_run_becomes_a_learner(spark):
    forest, rest = models.tuned_learner("random_forest", {"n_estimators": 80, "max_depth": None, "min_samples_leaf": "3", "max_features": None,
                                                          "bootstrap": "True", "min_samples_split": 5, "class_weight": "balanced"})
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (80, 30, 3)
    assert forest.getFeatureSubsetStrategy() == "all" and forest.getBootstrap() and forest.getWeightCol() == "weight"
    assert rest == ["class_weight", "min_samples_split"]
    boosted, rest = models.tuned_learner("lightgbm", {"n_estimators": "120", "max_depth": -1, "learning_rate": "0.05", "subsample": 0.7, "num_leaves": 40})
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize(), boosted.getSubsamplingRate()) == (120, 30, 0.05, 0.7)
    assert rest == ["num_leaves"]


def test_stopping_is_told_by_the_first_standstill():
    assert models.stopping([5, 4, 3, 3, 3, 2], 2) == (3, 5)
    assert models.stopping([5, 4, 3, 3, 2, 2], 2) == (5, None)
    assert models.stopping([1.0], 20) == (1, None) and models.stopping([1, 2, 3], 2) == (1, 3)


def test_boosting_ends_after_patience_and_keeps_the_best_rounds(spark):
    rng = random.Random(1)
    rows = [(x := rng.random(), rng.random(), int((x > 0.5) != (rng.random() < 0.25)), i % 4 == 0) for i in range(600)]
    data = spark.createDataFrame(rows, "a double, b double, y int, held boolean")
    found = models.train_boosted(data, ["a", "b"], "y", "held", rounds=40, patience=3, stepSize=0.5, maxDepth=4)
    assert found.stop_round == found.best_round + 3 <= 40 and len(found.losses) == found.stop_round
    assert found.losses[found.best_round - 1] == min(found.losses)
    assert len(found.model.stages[-1].trees) == found.best_round
    assert models.score(data, found.model).where("prediction = y").count() > 350
    few = models.train_boosted(data, ["a", "b"], "y", "held", rounds=2, patience=3, maxDepth=2)
    assert few.best_round <= few.stop_round == 2


def test_multiclass_boosting(spark):
    data = spark.createDataFrame([(float(i), float(i % 5), i // 40) for i in range(120)], "a double, b double, y int")
    model = models.train_boosted_multiclass(data, ["a", "b"], "y", maxIter=2, maxDepth=2)
    scored = models.score(data, model)
    assert scored.where("y = prediction").count() > 100 and scored.where("confidence <= 0 or confidence >= 1").count() == 0


# --------------------------------------------------------------------------- captures

def _frame(src, dst, sport, dport, proto, payload, flags=0x12, window=512, vlan=False, kind=0x0800, fragment=0):
    if proto == 6:
        l4 = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, window, 0, 0)
    else:
        l4 = struct.pack("!HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 0, fragment, 64, proto, 0,
                     bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    tag = struct.pack("!HH", 0x8100, 5) if vlan else b""
    return bytes(12) + tag + struct.pack("!H", kind) + ip + l4 + payload


FRAMES = [
    (1_000_000, _frame("10.0.0.1", "10.0.0.2", 1234, 443, 6, b"hello")),
    (1_500_000, _frame("10.0.0.2", "10.0.0.1", 443, 1234, 17, b"abc", vlan=True)),
    (1_600_000, _frame("10.0.0.1", "10.0.0.2", 0, 0, 1, b"ping")),
    (1_700_000, _frame("10.0.0.1", "10.0.0.2", 1, 2, 6, b"x", kind=0x86DD)),
    (1_800_000, _frame("10.0.0.1", "10.0.0.2", 1, 2, 6, b"x", fragment=5)),
    (1_900_000, _frame("192.168.1.9", "10.0.0.2", 65535, 80, 6, b"", flags=0x01, window=0)),
]


def _pcap(order, nano):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, f in FRAMES:
        s, frac = divmod(us, 1_000_000)
        out += struct.pack(order + "IIII", s, frac * (1000 if nano else 1), len(f), len(f)) + f
    return out


def _pcapng():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for us, f in FRAMES:
        ns = us * 1000
        out += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("content", [_pcap("<", False), _pcap(">", False), _pcap("<", True), _pcapng()],
                         ids=["little", "big", "nano", "ng"])
def test_captures(spark, tmp_path, content):
    for name in ("a.pcap", "b.pcap"):
        (tmp_path / name).write_bytes(content)
    df = captures.read_captures(spark, str(tmp_path))
    assert df.count() == 6 and df.select("packet_id").distinct().count() == 6
    got = [tuple(r)[1:-1] for r in df.where("capture = 'a.pcap'").orderBy("ts_us").collect()]
    assert got == [
        (1_000_000, "10.0.0.1", "10.0.0.2", 1234, 443, 6, 40, 5, 45, 0x12, 512),
        (1_500_000, "10.0.0.2", "10.0.0.1", 443, 1234, 17, 28, 3, 31, 0, 0),
        (1_900_000, "192.168.1.9", "10.0.0.2", 65535, 80, 6, 40, 0, 40, 1, 0)]
    # The limit counts packets of every kind.
    assert captures.read_captures(spark, str(tmp_path), max_packets=4).count() == 4


def _ip_frame(src: int) -> bytes:
    return struct.pack(">BBHHHBBHII", 0x45, 0, 48, 0, 0, 64, 6, 0, 0x0A000000 + src, 0x0A000002) + struct.pack(
        ">HHIIBBHHH", 1234, 443, 0, 0, 0x50, 0x10, 512, 0, 0) + bytes(8)


def _pcap(link: int, frames: list[bytes]) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link) + b"".join(
        struct.pack("<IIII", i, 0, len(f), len(f)) + f for i, f in enumerate(frames, 1))


def _block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def test_capture_kinds_and_audit(spark, tmp_path):
    ip = _ip_frame(1)
    section = _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(1, struct.pack("<HHI", 101, 0, 65535))
    files = {
        "loopback": _pcap(0, [b"\2\0\0\0" + ip, b"\0\0\0\2" + ip, b"\x1e\0\0\0" + bytes(40)]),
        "ipv4": _pcap(228, [ip]), "cooked2": _pcap(276, [b"\x08\x00" + bytes(18) + ip]),
        "unknown": _pcap(105, [ip, ip]), "cut": _pcap(101, [ip, ip])[:-5], "cut_header": _pcap(101, [ip])[:10],
        "empty": b"", "text": b"no capture at all", "bare": _pcap(101, []),
        "blocks": section + _block(2, struct.pack("<HHIIII", 0, 0, 0, 5_000_000, len(ip), len(ip)) + ip)
        + _block(3, struct.pack("<I", len(ip)) + ip)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    packets = {r.capture: r["count"] for r in captures.read_captures(spark, str(tmp_path)).groupBy("capture").count().collect()}
    assert packets == {"loopback": 2, "ipv4": 1, "cooked2": 1, "cut": 1, "blocks": 1}
    audit = {r.capture: tuple(r)[1:] for r in captures.capture_audit(spark, str(tmp_path)).collect()}
    assert audit == {
        "loopback": ("pcap", 3, 2, 0, 1, 0, False), "ipv4": ("pcap", 1, 1, 0, 0, 0, False),
        "cooked2": ("pcap", 1, 1, 0, 0, 0, False), "unknown": ("pcap", 2, 0, 2, 0, 0, False),
        "cut": ("pcap", 1, 1, 0, 0, 0, True), "cut_header": ("pcap", 0, 0, 0, 0, 0, True),
        "empty": (None, 0, 0, 0, 0, 0, False), "text": (None, 0, 0, 0, 0, 0, False), "bare": ("pcap", 0, 0, 0, 0, 0, False),
        "blocks": ("pcapng", 2, 1, 0, 0, 1, False)}


def _long_pcap(n: int, nested: bytes = b"") -> bytes:
    """Records of many sizes and kinds; `nested` goes as payload into the middle."""
    frames = [_ip_frame(i % 200) + bytes(i * 37 % 400) if i % 5 else b"\x60" + bytes(i % 90) for i in range(n)]
    if nested:
        frames.insert(n // 2, _ip_frame(250) + nested)
    return _pcap(101, frames)


def _long_blocks(n: int) -> bytes:
    """Sections in both halves, interfaces of other kinds and clocks on the way."""
    def section(link, power):
        return _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(
            1, struct.pack("<HHI", link, 0, 65535) + struct.pack("<HHB3x", 9, 1, power) + struct.pack("<HH", 0, 0))

    out = section(101, 6)
    for i in range(n):
        if i == n // 3:
            out += _block(1, struct.pack("<HHI", 228, 0, 65535))
        if i == 2 * n // 3:
            out += section(228, 9)
        body = _ip_frame(i % 200) + bytes(i * 13 % 300)
        port = int(n // 3 <= i < 2 * n // 3)
        out += _block(3, struct.pack("<I", len(body)) + body) if i % 11 == 3 else _block(6, struct.pack("<IIIII", port, 0, 10**6 + i, len(body), len(body)) + body)
    return out


@pytest.mark.parametrize("content", [_long_pcap(400), _long_pcap(300, _long_pcap(300)), _long_pcap(200)[:-9], _long_blocks(500), _long_blocks(90) + b"tail"],
                         ids=["pcap", "a capture inside", "cut off", "sections", "trailing bytes"])
def test_any_range_size_gives_the_same_packets(spark, tmp_path, content):
    (tmp_path / "one").write_bytes(content)
    (tmp_path / "two").write_bytes(_long_pcap(40))
    whole = sorted(map(tuple, captures.read_captures(spark, str(tmp_path)).collect()), key=str)
    audit = sorted(map(tuple, captures.capture_audit(spark, str(tmp_path)).collect()))
    for size in (4_000, 17_001):
        df = captures.read_captures(spark, str(tmp_path), range_bytes=size)
        assert df.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, df.collect()), key=str) == whole
        assert sorted(map(tuple, captures.capture_audit(spark, str(tmp_path), range_bytes=size).collect())) == audit
    few = captures.read_captures(spark, str(tmp_path), max_packets=50).collect()
    assert sorted(captures.read_captures(spark, str(tmp_path), 50, 5000).collect()) == sorted(few)


def test_a_false_start_is_found_and_walked_again(spark, tmp_path):
    (tmp_path / "one").write_bytes(_long_pcap(300, _long_pcap(300)))
    (path, size), = [(r.path, r.length) for r in spark.read.format("binaryFile").load(str(tmp_path)).collect()]
    content = (tmp_path / "one").read_bytes()
    layout = captures.Layout("pcap", "<", False, ((101, 1_000_000),))
    inside = content.index(_long_pcap(300)) + 2000
    with open(tmp_path / "one", "rb") as f:
        guess = captures._entered(f, inside, inside + 2000, size, layout)
    at, true = 24, set()
    while at < size:
        true.add(at)
        at += 16 + struct.unpack_from("<I", content, at + 8)[0]
    assert guess is not None and guess not in true
    assert {p.at for p in captures.settled(spark, [(path, size)], 2000)} <= true


def test_addresses_of_hadoop_connectors():
    from flowloom.sources import files
    assert [files.outside_hadoop(a) for a in ("s3a://b/x", "s3n://b/x", "wasbs://c@a.host/x", "hdfs://h/x", "file:/tmp/a b")] == [
        "s3://b/x", "s3://b/x", "abfss://c@a.host/x", "hdfs://h/x", "file:/tmp/a b"]
    assert files.located("file:/tmp/a")[1] == files.located("file:///tmp/a")[1] == "/tmp/a"


def test_feature_list_is_complete():
    assert len(set(FEATURES)) == 77


def test_csv_folder_with_a_stray_file_and_a_blank_in_a_name(spark, tmp_path):
    folder = tmp_path / "flow days"
    folder.mkdir()
    (folder / "day one.csv").write_text("Flow Duration,Label\n5,BENIGN\n")
    (folder / "README.txt").write_text("not a table")
    rows = csv_flows.read_flow_csvs(spark, str(folder)).collect()
    assert [r["Flow Duration"] for r in rows] == [5.0]
