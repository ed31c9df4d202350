"""Every registered query against its SQL twin, on the small tables."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tools.check_queries import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    result = compare(spark, con, name, sf)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_twin_gives_rows(spark, con, sf, name):
    assert not compare(spark, con, name, sf).endswith(" 0 rows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_models_are_trained_on_the_whole_table_with_the_presets(spark, sf, monkeypatch):
    from flowloom.operators import models
    from flowloom.plans import model_queries
    from flowloom.sources.bindings import RAW_FEATURES

    assert model_queries.FEATURES == RAW_FEATURES
    seen = []

    def fit(df, features, label, learner, extra=(), scaler=None):
        assert features == RAW_FEATURES
        seen.append({p.name: v for p, v in learner.extractParamMap().items()})
        raise StopIteration

    def boost(df, features, label, validation, preset):
        assert features == RAW_FEATURES and models.MOST_ROUNDS == 500 and models.PATIENCE == 20
        seen.append({"preset": preset})
        raise StopIteration

    monkeypatch.setattr(models, "train", fit)
    monkeypatch.setattr(models, "train_boosted", boost)
    for name in ("rf_importance", "train_rf", "train_gbt", "train_gbt_leafwise"):
        with pytest.raises(StopIteration):
            getattr(model_queries, name)(spark, sf)
    assert [(p["numTrees"], p["maxDepth"]) for p in seen[:2]] == [(100, 10)] * 2
    assert [p["preset"] for p in seen[2:]] == ["xgboost", "lightgbm"]


def test_scoring_loads_the_stored_forest(spark, sf, monkeypatch):
    from flowloom.plans import model_queries

    model_queries._stored_forest(spark, sf)
    monkeypatch.setattr(model_queries, "_train_forest", None)
    assert model_queries.score_batch(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
