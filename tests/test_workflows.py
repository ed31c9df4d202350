from pyspark.sql import functions as F

from flowloom import workflows
from flowloom.functions.columns import c
from flowloom.operators import alerts, flow_features, models
from flowloom.plans.packet_queries import RULES
from flowloom.sources.bindings import RAW_FEATURES, spark_view


def test_offline_build(spark, sf):
    raw = spark_view(spark, sf, "raw_flows").drop("row_key")
    table, mapping = workflows.prepare_dataset(raw.drop("source_file"), ratio=1.5)
    sizes = {tuple(r)[:2]: r[2] for r in table.groupBy("Label_Binary", "split").count().collect()}
    by_class = {y: sum(n for (k, _), n in sizes.items() if k == y) for y in (0, 1)}
    assert by_class[1] <= int(by_class[0] * 1.5) and len(sizes) == 6 and mapping.count() == 3
    train = table.where("split = 'train'")
    fitted, importances = workflows.fit_features(train, top=3, numTrees=5, maxDepth=3, minInstancesPerNode=5)
    # One feature never varies, one is twice another.
    assert "Fwd Avg Bytes/Bulk" not in fitted.kept and "Subflow Fwd Bytes" not in fitted.kept
    assert len(fitted.selected) == 3 and importances.count() == len(fitted.kept)
    model = workflows.train_model(train, fitted, models.random_forest(numTrees=3, maxDepth=3))
    report = workflows.evaluate_by_file(raw, model, RAW_FEATURES).collect()
    assert len(report) == 7
    assert sum(r.tp + r.fp + r.tn + r.fn for r in report) == raw.count()


def test_detection_on_packets(spark, sf, tmp_path):
    packets = spark_view(spark, sf, "packets")
    table = flow_features.flow_features(packets, RULES).withColumn("y", (c("Packet Length Mean") > 85).cast("int"))
    # A name with a dot must survive training, saving and loading.
    names = ["Fwd Header Length.1", "Packet Length Mean", "Flow Bytes/s"]
    model = models.train(table, names, "y", models.random_forest(numTrees=3, maxDepth=3),
                         scaler={"Packet Length Mean": (85.0, 1e-05)})
    model.write().overwrite().save(str(tmp_path / "m"))
    again = models.PipelineModel.load(str(tmp_path / "m"))
    mapping = spark.createDataFrame([("BENIGN", 0), ("ATTACK", 1)], "label string, code int")
    scored = workflows.detect(packets, again, mapping, RULES)
    stats = alerts.session_stats(packets, scored).first()
    assert stats.flows_analyzed == table.count() and stats.packets_processed == packets.count()
    assert stats.attacks_detected == table.where("y = 1").count() == alerts.attack_log(scored).count()
    blocked = alerts.block_list(scored, source="initiator_ip")
    assert blocked.count() == alerts.alerts(scored, 0.7).select("initiator_ip").distinct().count() > 0
    assert scored.agg(F.min("confidence")).first()[0] >= 0.5
