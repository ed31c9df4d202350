import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.columns import c
from flowloom.functions.quantiles import exact_quantiles
from flowloom.functions.running import with_running_totals
from flowloom.operators import clean, feature_stats, labels, metrics, quality, sampling, scorecard, timing


def rows(df):
    return sorted(map(tuple, df.collect()))


# --------------------------------------------------------------------------- shared functions

def _numbers():
    rng = random.Random(7)
    return [(rng.choice([1.0, 2.0, 3.5]) if i % 3 == 0 else rng.gauss(0, 10) ** 3, None if i % 5 == 0 else float(i))
            for i in range(2000)] + [(float("inf"), float("nan"))]


@pytest.mark.parametrize(("accuracy", "gathered"), [(10_000, 2_000_000), (100, 2_000_000), (20, 100)])
def test_exact_quantiles(spark, accuracy, gathered):
    df = spark.createDataFrame(_numbers(), "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.753, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, accuracy, gathered)
    for name, i in (("a", 0), ("b", 1)):
        values = [r[i] for r in _numbers() if r[i] is not None and math.isfinite(r[i])]
        assert got[name] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_ranges(spark, descending):
    rng = random.Random(3)
    values = {rng.expovariate(1) * (1000 if rng.random() < 0.1 else 1): rng.randint(1, 5) for _ in range(3000)}
    df = spark.createDataFrame(list(values.items()), "x double, n bigint")
    order = sorted(values, reverse=descending)
    want = dict(zip(order, itertools.accumulate(values[x] for x in order)))
    for parts in (None, 7):
        got = with_running_totals(df, "x", {"n": "cum"}, descending, partitions=parts).collect()
        assert {r.x: r.cum for r in got} == want and {r.all_cum for r in got} == {sum(values.values())}
    assert with_running_totals(df.limit(0), "x", {"n": "cum"}, descending).count() == 0


def test_running_totals_in_groups_of_all_sizes(spark):
    rng = random.Random(4)
    data = [(g, x, rng.randint(1, 5), rng.random()) for g, n in (("big", 2000), (None, 30), ("one", 1), ("b", 400)) for x in rng.sample(range(9000), n)]
    df = spark.createDataFrame(data, "g string, x int, n int, w double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {(r.g, r.x): (r.cum, r.mass) for r in with_running_totals(df, "x", {"n": "cum", "w": "mass"}, groups=["g"], partitions=9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in {r[0] for r in data}:
        mine = sorted(r for r in data if r[0] == g) if g else sorted((r for r in data if r[0] is None), key=lambda r: r[1])
        for k, r in enumerate(mine):
            n, w = got[g, r[1]]
            assert n == sum(m[2] for m in mine[:k + 1]) and w == pytest.approx(sum(m[3] for m in mine[:k + 1]))


def test_quantiles_take_two_scans_of_the_wide_table(spark, tmp_path):
    spark.range(30_000).selectExpr("cast(id as double) a", "pow(id % 977, 2) b", "cast(id % 3 as double) c").write.parquet(str(tmp_path / "t"))
    listed = spark.sparkContext._jsc.sc().statusStore()
    before = listed.jobsList(None).size()
    got = exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["a", "b", "c"], [0.1, 0.5, 0.9])
    assert listed.jobsList(None).size() - before <= 5  # a listing at most, and two jobs of a scan and its merge
    assert got["a"] == pytest.approx(np.quantile(np.arange(30_000), [0.1, 0.5, 0.9]).tolist())
    assert got["c"] == [0.0, 1.0, 2.0]


# --------------------------------------------------------------------------- cleaning

def test_clean_drops_infinite_and_fills_missing(spark):
    df = spark.createDataFrame(
        [("a", 1.0, float("inf"), "BENIGN"), ("b", 3.0, float("nan"), "DoS"), ("c", 5.0, None, "BENIGN"),
         ("d", 5.0, 0.0, "BENIGN")], ["Flow ID", "x", "Flow Bytes/s", " Label"])
    assert rows(clean.clean(df)) == [(3.0, 0.0, "DoS"), (5.0, 0.0, "BENIGN")]
    audit = clean.cleaning_audit(df).first().asDict()
    assert audit == {"rows_in": 4, "infinite_rows": 1, "filled_cells": 2, "duplicate_rows": 1, "rows_out": 2}
    assert clean.serving_clean(df).count() == 4


def test_align_contract_and_selection(spark):
    df = spark.createDataFrame([(1.0, 2.0, "BENIGN")], [" flow duration", "FLOW BYTES/S", "Label"])
    got = clean.align(df, ["Flow Bytes/s", "Idle Max", "Flow Duration"]).first()
    assert tuple(got) == (2.0, 0.0, 1.0)
    with pytest.raises(KeyError):
        clean.select_features(df, ["Idle Max"])
    assert clean.select_by_index(df, [" flow duration", "FLOW BYTES/S"], ["flow bytes/s", "nope"]).columns == ["FLOW BYTES/S"]
    assert clean.check_contract(df, ["Label", "Target"], 2) == ["missing column: Target", "fewer than 2 rows"]


def test_label_codes(spark):
    df = spark.createDataFrame([(" Benign ",), ("DoS",), ("Bot",)], ["Label"])
    encoded, mapping = labels.encode_labels(df)
    assert rows(encoded.select("Label_Original", "Label_Binary", "Label_Multiclass")) == [
        (" Benign ", 0, 0), ("Bot", 1, 1), ("DoS", 1, 2)]
    decoded = labels.decode_labels(spark.createDataFrame([(1,), (9,)], "prediction int"), mapping)
    assert rows(decoded) == [(1, "Bot"), (9, "CLASS_9")]


# --------------------------------------------------------------------------- sampling

def _classes(spark, sizes):
    return spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "key string, y string")


def counts(df, *by):
    return {tuple(r)[:-1] if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).count().collect()}


def test_balance_keeps_only_the_extreme_classes(spark):
    df = _classes(spark, {"a": 100, "b": 50, "c": 20})
    assert counts(sampling.balance(df, "key", 2.0, "y"), "y") == {"a": 40, "c": 20}
    assert counts(sampling.balance(df, "key", 50.0, "y"), "y") == {"a": 100, "c": 20}


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_disjoint_complete_and_stratified(spark, digits):
    df = _classes(spark, {"a": 1000, "b": 101})
    split = sampling.stratified_split(df, "key", "y")
    assert split.count() == 1101 and split.select("key").distinct().count() == 1101
    assert counts(split, "y", "split") == {("a", "test"): 150, ("a", "val"): 150, ("a", "train"): 700,
                                           ("b", "test"): 15, ("b", "val"): 15, ("b", "train"): 71}
    by_rank = sampling.cut_by_rank(df, "y", "key", 1, lambda t: {k: [n // 2] for k, n in t.items()}, digits)
    assert counts(by_rank.where("part = 0"), "y") == {"a": 500, "b": 50}


def test_folds_and_samples(spark):
    df = _classes(spark, {"a": 103, "b": 7})
    folds = counts(sampling.assign_folds(df, "key", 5, "y"), "fold")
    assert sum(folds.values()) == 110 and max(folds.values()) - min(folds.values()) <= 2 and len(folds) == 5
    assert sampling.sample_n(df, "key", 9).count() == 9
    assert sampling.sample_n(df, "key", 9999).count() == 110
    assert sampling.shuffle_rows(df).count() == 110


# --------------------------------------------------------------------------- statistics

def test_correlation_rule(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    same = spark.createDataFrame([(float(x), float(2 * x), float(-x), 1.0) for x in a], ["a", "b", "c", "k"])
    assert feature_stats.correlation_filter(same, ["a", "b", "c", "k"]) == ["a", "k"]
    assert feature_stats.variance_filter(same, ["a", "b", "c", "k"]) == ["a", "b", "c"]
    # a-b and b-c correlate above the limit, a-c does not: both b and c go.
    step = [rng.normal(size=500) for _ in range(2)]
    b = a + 0.3 * step[0]
    chain = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), (b + 0.3 * step[1]).tolist())), ["a", "b", "c"])
    r = feature_stats.correlation_matrix(chain, ["a", "b", "c"])
    limit = (r[("a", "c")] + min(r[("a", "b")], r[("b", "c")])) / 2
    assert feature_stats.correlation_filter(chain, ["a", "b", "c"], limit) == ["a"]


def test_correlation_with_gaps_uses_common_rows(spark):
    data = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, None), (4.0, 1.0, 5.0), (float("nan"), 9.0, 6.0)]
    got = feature_stats.correlation_matrix(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"])
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 7, 1])[0, 1], abs=1e-12)
    assert got["b", "c"] == pytest.approx(np.corrcoef([2, 1, 9], [5, 5, 6])[0, 1], abs=1e-12)
    assert got["a", "c"] is None  # c does not vary where a has a value
    assert set(feature_stats.correlation_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).values()) == {None}


def test_wide_correlation_equals_pairs(spark):
    rng = np.random.default_rng(1)
    names = [f"x{i}" for i in range(13)]
    data = rng.normal(size=(200, 13)) @ rng.normal(size=(13, 13))
    data[:, 5] = 1.0
    df = spark.createDataFrame(data.tolist(), names)
    got = feature_stats.correlation_matrix(df, names)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(data.T)
    for (a, b), v in got.items():
        w = want[names.index(a), names.index(b)]
        assert v is None if math.isnan(w) else v == pytest.approx(w, abs=1e-9)


def test_scalers(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(5)], ["a", "k"])
    robust = feature_stats.fit_robust_scaler(df, ["a", "k"])
    assert robust == {"a": (2.0, 2.0), "k": (5.0, 1.0)}
    standard = feature_stats.fit_standard_scaler(df, ["a", "k"])
    assert standard["a"] == (2.0, pytest.approx(math.sqrt(2))) and standard["k"] == (5.0, 1.0)
    assert rows(feature_stats.scale(df, robust))[0] == (-1.0, 0.0)


# --------------------------------------------------------------------------- metrics

def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9)], "y_true int, y_pred int, y_prob double")
    m = metrics.binary_metrics(df).first()
    assert (m.tp, m.fp, m.tn, m.fn) == (0, 1, 1, 0) and m.recall == 0 and m.f2 == 0
    assert metrics.roc_auc(df).first()[0] is None
    assert metrics.average_precision(df).first()[0] is None


def test_curves_against_brute_force(spark):
    rng = random.Random(5)
    data = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(data, "y_true int, y_prob double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    area, last = 0.0, 0.0
    for t in sorted({s for _, s in data}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        area += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert metrics.average_precision(df).first()[0] == pytest.approx(area)
    assert max(r.tpr for r in metrics.roc_curve(df).collect()) == 1.0


def test_areas_of_groups_are_those_of_each_group_alone(spark):
    rng = random.Random(9)
    data = [(g, int(rng.random() < 0.3), round(rng.random(), 3)) for g, n in ((1, 1500), (2, 40), (None, 60)) for _ in range(n)]
    data += [(1, 1, None), (1, 0, float("nan")), (3, 0, 0.5), (4, 1, None)]
    df = spark.createDataFrame(data, "g int, y_true int, y_prob double")
    got = {r.g: tuple(r)[1:] for r in metrics.areas(df, by=["g"]).collect()}
    for g in (1, 2, None):
        own = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert got[g][:2] == pytest.approx((metrics.roc_auc(own).first()[0], metrics.average_precision(own).first()[0]))
    assert got[1][4] == 2 and got[3] == (None, None, 0, 1, 0) and got[4] == (None, None, 0, 0, 1)


# --------------------------------------------------------------------------- scorecard, quality, timing

def test_scorecard_rules(spark):
    df = spark.createDataFrame([
        ("xgboost", "good", 0.9952, 0.9994, None, 0.5, None), ("xgboost", "slow", 0.9952, 0.9994, 0.001, 1.5, 0.9),
        ("xgboost", "noisy", 0.90, 0.99, None, 0.5, 0.8)],
        "model_type string, version_id string, precision double, recall double, false_positive_rate double, "
        "latency_ms double, f1 double")
    got = {r.version_id: r for r in scorecard.scorecard(df).collect()}
    p, r = 0.9952, 0.9994
    assert got["good"].fpr == 0.005 and got["good"].fpr_estimated and got["good"].status == "PASS"
    assert got["good"].score == pytest.approx(0.7 * 5 * p * r / (4 * p + r) + 0.3 * 0.5)
    assert got["slow"].status == got["noisy"].status == "FAIL" and got["slow"].score == got["noisy"].score == 0
    assert scorecard.best_passing(scorecard.scorecard(df)).first().version_id == "good"


def test_intra_rank(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(
        [(rng.choice(["a", "a", "a", "b"]), f"v{i:03}", "PASS", float(rng.randint(0, 3)), 0.5) for i in range(300)],
        "model_type string, version_id string, status string, score double, f1 double")
    w = W.partitionBy("model_type")
    want = df.withColumns({
        "merit": F.col("score"), "intra_rank": F.row_number().over(w.orderBy(F.desc("score"), "version_id")),
        "total_versions": F.count("*").over(w)})
    assert rows(want) == rows(scorecard.intra_rank(df).select(*want.columns))


def test_latest_config(spark):
    df = spark.createDataFrame([
        ("xgboost", "binary", "2026-01-01", "a_2026-01-01.json"), ("xgboost", "multiclass", "2026-01-03", "b_2026-01-03.json"),
        ("xgboost", "binary", "2026-01-02", "c_2026-01-02.json")],
        "model_type string, task string, tuning_timestamp string, file_name string")
    assert scorecard.latest_config(df, "xgboost").first().file_name == "c_2026-01-02.json"
    assert scorecard.latest_config(df, "xgboost", timestamp="01-01").first().file_name == "a_2026-01-01.json"
    assert scorecard.latest_config(df, "xgboost", file_name="x/b_2026-01-03.json").first() is None


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_nearest_flow_match(spark, partitions):
    rng = random.Random(11)
    ext = [(rng.choice("ab"), rng.randint(0, 400), i) for i in range(60)]
    lab = [(rng.choice("ab"), rng.randint(0, 400), i) for i in range(25)] + [("z", 1, 99)]
    ddl = "flow_key string, start_us bigint, id bigint"
    got = {r.id: r.labelled_start_us for r in quality.match_flows(
        spark.createDataFrame(ext, ddl), spark.createDataFrame(lab, ddl), [], partitions).collect()}
    for key, us, i in ext:
        best = min((abs(t - us), t) for k, t, _ in lab if k == key)
        assert got[i] == best[1]
    assert len(got) == 60


def test_values_are_not_sorted_to_match_flows(spark, monkeypatch):
    seen, place = [], quality.placed
    monkeypatch.setattr(quality, "placed", lambda df, *a: seen.extend(df.columns) or place(df, *a))
    ext = spark.createDataFrame([("a", 5, 1, 2.0), ("a", 50, 2, 3.0), (None, 7, 3, 4.0), ("b", 1, 4, 1.0)], "flow_key string, start_us long, id long, x double")
    lab = spark.createDataFrame([("a", 9, 8, 2.5), ("a", 1, 9, None), (None, 7, 7, 4.0)], "flow_key string, start_us long, id long, x double")
    got = {r.id: (r.labelled_id, r.actual.v0, r.expected.v0) for r in quality.match_flows(ext, lab, ["x"]).collect()}
    assert got == {1: (9, 2.0, None), 2: (8, 3.0, 2.5)}  # a flow without a key matches none
    assert "actual" not in seen and "spot" in seen
    judged = quality.compare_matched_flows(ext, lab, ["x"]).collect()
    assert {(r.id, r.category, r.tolerance, r.passed) for r in judged} == {(2, "other", 0.2, True)}


def test_relative_difference_and_tolerance(spark):
    df = spark.createDataFrame([("Flow Duration", 10.0, 13.0), ("Total Fwd Packets", 10.0, 11.0), ("x", 0.0, 5.0),
                                ("y", 0.0, 0.0)], "feature string, expected double, actual double")
    got = {r.feature: r for r in quality.judged(df).collect()}
    assert got["Flow Duration"].passed and not got["Total Fwd Packets"].passed
    assert got["x"].relative_diff == 1.0 and not got["x"].passed and got["y"].passed and got["y"].category == "other"
    assert quality.critical_failures(quality.judged(df)).first().feature == "Total Fwd Packets"


def test_drift_correlation_and_findings(spark):
    df = spark.createDataFrame([(float(i), float(3 * i), 1.0) for i in range(20)], ["a", "b", "Flow Duration"])
    assert quality.paired_correlation(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert quality.paired_correlation(df.limit(5), "a", "b").first()[0] is None
    found = rows(quality.calibration_findings(df, ["Flow Duration", "Idle Max", "Fwd IAT Max"]))
    assert found == [("critical_missing", "Fwd IAT Max"), ("missing", "Fwd IAT Max"), ("missing", "Idle Max"),
                     ("zero_variance", "Flow Duration")]
    drift = quality.drift_compare(df, df.withColumn("a", c("a") * 2), ["a", "b"])
    assert {r.feature: r.mean_diff_pct for r in drift.collect()} == {"a": 100.0, "b": 0.0}
    assert [r.feature for r in quality.high_discrepancy(drift).collect()] == ["a"]
    assert not quality.coverage_report(df).first().is_valid


def test_ks_identical_and_disjoint(spark):
    a = spark.createDataFrame([(float(i),) for i in range(100)], ["x"])
    same = quality.ks_two_sample(a, a, "x").first()
    apart = quality.ks_two_sample(a, a.select((F.col("x") + 1000).alias("x")), "x").first()
    assert same.ks_statistic == 0 and same.ks_pvalue == 1
    assert apart.ks_statistic == 1 and apart.ks_pvalue < 1e-12


def test_timing_skips_internal_operations(spark):
    runs = spark.createDataFrame([("m", "s", "2026", 10.0, {"load": 4.0, "_metrics": 9.0}, {"k": "v"})],
                                 "module string, session_id string, start string, total_duration double, "
                                 "operations map<string,double>, parameters map<string,string>")
    assert rows(timing.operation_share(runs).select("operation", "percent")) == [("load", 40.0)]
    assert rows(timing.parameter_values(runs)) == [("m", "k", "v")]


def test_classes_without_a_value_stay_and_samples_are_exact(spark):
    from flowloom.operators import sampling
    rows = [(i, None if i % 10 == 0 else i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, y int")
    assert sampling.stratified_split(df, "k", "y").count() == 100
    assert sampling.assign_folds(df, "k", 5, "y").count() == 100
    assert sampling.stratified_sample(df, "k", 37, "y").count() == 37
    even = spark.createDataFrame([(i, i % 40) for i in range(400)], "k long, y int")
    assert sampling.stratified_sample(even, "k", 50, "y").count() == 50


def test_align_reads_text_that_is_no_number_as_null(spark):
    from flowloom.operators import clean
    got = clean.align(spark.createDataFrame([("1.5",), ("n/a",)], "a string"), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(1.5, 0.0), (None, 0.0)]


def test_block_list_names_the_initiator(spark):
    from flowloom.operators import alerts
    import inspect
    assert inspect.signature(alerts.block_list).parameters["source"].default is None
