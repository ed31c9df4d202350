"""Forests over binned and counted rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from flowloom.operators import boosting, forests, models


@pytest.fixture(scope="module")
def repeated(spark):
    """4,000 rows of 16 kinds: `y` follows `a`, with one row in ten wrong, and `b` is noise."""
    return spark.range(4000).select(
        (F.col("id") % 8).cast("double").alias("a"), F.expr("cast(id div 8 % 2 as double)").alias("b"),
        F.expr("cast((id % 8 > 4) != (id div 16 % 10 = 0) as int)").alias("y"))


def test_a_forest_is_fitted_on_groups_of_equal_rows(spark, repeated, tmp_path, monkeypatch):
    seen, fit = [], RandomForestClassifier.fit

    def counted(self, dataset, params=None):
        seen.append(dataset.count())
        return fit(self, dataset, params)

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    model = models.train(repeated, ["a", "b"], "y", models.random_forest(numTrees=6, maxDepth=3, minInstancesPerNode=5))
    assert len(seen) == 6 and max(seen) <= 32  # kinds and labels, not 4,000 rows
    assert model.stages[-1].getNumTrees == 6
    model.write().overwrite().save(str(tmp_path / "forest"))
    scored = models.score(repeated, models.PipelineModel.load(str(tmp_path / "forest")))
    assert scored.where("(prediction = 1) != (a > 4)").count() == 0
    assert scored.where("confidence between 0.5 and 1").count() == 4000


def test_groups_give_the_tree_of_their_rows(repeated):
    params = dict(numTrees=1, maxDepth=3, bootstrap=False, featureSubsetStrategy="all")
    grouped = models.train(repeated, ["a", "b"], "y", models.random_forest(**params))
    stages = models.input_stages(["a", "b"])
    rows = models.Pipeline(stages=[*stages, models.random_forest(**params)]).fit(models.training_table(repeated, ["a", "b"], "y"))
    a, b = (models.score(repeated, m).selectExpr("a", "b", "prediction", "round(confidence, 9)").distinct().collect() for m in (grouped, rows))
    assert len(grouped.stages) > len(rows.stages) and set(a) == set(b)


def test_rows_of_equal_bins_are_scored_once(repeated, monkeypatch):
    model = models.train(repeated, ["a", "b"], "y", models.random_forest(numTrees=6, maxDepth=3))
    seen, rows = [], models._scored_rows
    plain = rows(repeated, model)
    monkeypatch.setattr(models, "_scored_rows", lambda df, m: seen.append(df.count()) or rows(df, m))
    scored = models.score(repeated, model)
    assert seen == [16] and scored.columns == plain.columns
    assert scored.count() == 4000 and scored.exceptAll(plain).count() == 0


def test_rows_that_hardly_repeat_are_fitted_as_they_are(spark):
    data = spark.range(300).selectExpr("cast(id as double) as a", "rand(1) as b", "cast(id % 2 as int) as y")
    model = models.train(data, ["a", "b"], "y", models.random_forest(numTrees=2, maxDepth=2))
    assert len(model.stages) == 3


def test_bins_keep_rare_values_apart():
    assert forests.bin_edges([0.0] * 999 + [1.0], 32) == [1.0]
    edges = forests.bin_edges([0.0] * 900 + list(np.arange(1.0, 101.0)), 32)
    assert edges[0] == 1.0 and 25 <= len(edges) <= 31
    assert forests.bin_edges([3.0] * 10, 32) == []
    assert len(forests.bin_edges(list(range(1001)), 32)) == 31


@pytest.mark.parametrize("mean", [0.5, 3, 50, 51, 400])
def test_drawn_counts_are_poisson(mean):
    rng = np.random.default_rng(1)
    x = forests.poisson(np.full(100_000, float(mean)), rng.random(100_000), rng.random(100_000))
    assert abs(x.mean() - mean) < 0.02 * mean and abs(x.var() - mean) < 0.04 * mean and (x == np.rint(x)).all()


def test_boosting_makes_no_more_rounds_than_it_needs_to_stop(spark, monkeypatch):
    made, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, data, params=None: made.append(self.getMaxIter()) or fit(self, data, params))
    data = spark.range(400).selectExpr("rand(1) as a", "rand(2) as b", "cast(rand(3) > 0.5 as int) as y", "id % 2 = 0 as held")
    found = models.train_boosted(data, ["a", "b"], "y", "held", rounds=40, patience=3, maxDepth=2)
    assert made[0] == 4 and found.stop_round == found.best_round + 3


def test_a_search_fits_and_judges_counted_rows(repeated, monkeypatch):
    data = repeated.withColumn("fold", F.expr("cast(hash(a, b, y) % 7 = 0 as int)")).unionByName(
        repeated.withColumn("fold", F.expr("cast(rand(3) < 0.5 as int)")))
    learner, judge = models.random_forest(bootstrap=False, featureSubsetStrategy="all"), models.MulticlassClassificationEvaluator
    draws = models.draw_params(learner, {"numTrees": [1], "maxDepth": [1, 3]}, 4, seed=5)
    assert len({str(d) for d in draws}) == 2
    evaluate, seen = judge.evaluate, []
    monkeypatch.setattr(judge, "evaluate", lambda self, df, *a: seen.append(df.count()) or evaluate(self, df, *a))
    grouped = models.search(data, ["a", "b"], "y", learner, draws, "fold", 2)
    assert len(seen) == 8 and max(seen) <= 32  # 16 kinds with two labels at most, not thousands of rows
    monkeypatch.setattr(models, "_search_groups", lambda *a: None)
    rows = models.search(data, ["a", "b"], "y", learner, draws, "fold", 2)
    assert grouped.avgMetrics == pytest.approx(rows.avgMetrics)
    assert grouped.bestModel.stages[-1].getNumTrees == 1


def _held(repeated):
    return repeated.withColumn("held", F.col("a") * 7 % 3 + F.rand(4) < 0.7)


def test_rounds_on_groups_are_those_of_their_rows(spark, repeated, tmp_path, monkeypatch):
    from flowloom.functions.bounded import stabilise

    data = stabilise(_held(repeated))
    params = dict(subsamplingRate=1.0, maxDepth=2, stepSize=0.4, rounds=22, patience=30)  # past the rounds after which margins are stored
    grouped = models.train_boosted(data, ["a", "b"], "y", "held", **params)
    loaded = models.PipelineModel.load(_saved(grouped.model, tmp_path))
    monkeypatch.setattr(boosting, "counted_rows", lambda *a: None)
    rows = models.train_boosted(data, ["a", "b"], "y", "held", **params)
    assert len(grouped.model.stages) > len(rows.model.stages)
    assert grouped.losses == pytest.approx(rows.losses, rel=1e-9) and grouped.losses[0] > grouped.losses[-1]
    assert (grouped.best_round, grouped.stop_round) == (rows.best_round, rows.stop_round)
    a, b = (models.score(data, m).selectExpr("a", "b", "prediction", "round(confidence, 9)").distinct().collect() for m in (loaded, rows.model))
    assert len(a) == 16 and set(a) == set(b)


def _saved(model, folder):
    model.write().overwrite().save(str(folder / "boosted"))
    return str(folder / "boosted")


def test_boosting_makes_each_round_once_on_counted_rows(spark, repeated, monkeypatch):
    seen, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data, params=None: seen.append(data.count()) or fit(self, data, params))
    monkeypatch.setattr(models.GBTClassifier, "fit", None)
    found = models.train_boosted(_held(repeated), ["a", "b"], "y", "held", rounds=12, patience=2, maxDepth=3)
    assert len(seen) == found.stop_round == len(found.losses) <= 12 and max(seen) <= 32  # kinds and labels, not thousands of rows
    assert len(found.model.stages[-1].trees) == found.best_round
    assert found.losses[found.best_round - 1] == min(found.losses)
    assert models.score(repeated, found.model).where("(prediction = 1) = (a > 4)").count() == 4000


def test_leaves_of_groups_hold_the_least_rows(repeated):
    few = models.train_boosted(_held(repeated), ["a", "b"], "y", "held", rounds=1, patience=3, minInstancesPerNode=1_000, maxDepth=5)
    assert few.model.stages[-1].trees[0].numNodes <= 5  # some 2,900 rows to fit
    assert models.train_boosted(_held(repeated), ["a", "b"], "y", "held", rounds=1, patience=3, maxDepth=5).model.stages[-1].trees[0].numNodes > 5


@pytest.mark.parametrize("n,rate", [(1, 0.8), (7, 0.5), (40, 0.8), (249, 0.8), (251, 0.8), (5000, 0.8), (5000, 0.001), (30, 0.2)])
def test_entering_counts_are_binomial(n, rate):
    rng = np.random.default_rng(2)
    x = boosting.binomial(np.full(100_000, float(n)), rate, rng.random(100_000), rng.random(100_000))
    assert abs(x.mean() - n * rate) < 0.02 * np.sqrt(n * rate * (1 - rate)) and abs(x.var() / (n * rate * (1 - rate)) - 1) < 0.04
    assert (x == np.rint(x)).all() and x.min() >= 0 and x.max() <= n
