"""Training, search, scoring and versioned storage of tree ensembles with Spark ML."""

from __future__ import annotations

import math
import random
import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import pin_small, scratch, stabilise
from ..functions.columns import c
from . import boosting, forests
from .boosting import stopping
from .labels import class_weights

MAX_CLASSES = 1_000
INPUT = "_input_"
# The forest that ranks features.
IMPORTANCE_FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 50, "seed": 42}
# Bounds and choices of the tuning search, (kind, low, high) or a list of choices, under Spark ML's parameter names. Spark has
# no counterpart for: depths above 30 or without end, splits by rows of a node, column sampling per tree, L1 and L2 terms, leaf counts and
# searched class weights; leaving these out is ours.
SEARCH_SPACES = {
    "random_forest": {
        "numTrees": ("int", 50, 500), "maxDepth": [10, 20, 30], "minInstancesPerNode": ("int", 1, 10),
        "featureSubsetStrategy": ["sqrt", "log2", "all"], "bootstrap": [True, False]},
    "xgboost": {
        "maxIter": ("int", 100, 5000), "maxDepth": ("int", 3, 20), "stepSize": ("log", 0.001, 0.3),
        "subsamplingRate": ("float", 0.5, 1.0), "minInstancesPerNode": ("int", 1, 10),
        "minInfoGain": ("float", 0.0, 5.0)},
    "lightgbm": {
        "maxIter": ("int", 100, 5000), "maxDepth": ("int", 3, 30), "stepSize": ("log", 0.001, 0.3),
        "subsamplingRate": ("float", 0.5, 1.0), "minInstancesPerNode": ("int", 10, 100)},
}
# Boosting goes on for so many rounds at most, and ends after so many without a better loss on the validation rows.
MOST_ROUNDS, PATIENCE = 500, 20
# Settings under which one boosted-tree learner plays either library.
GBT_PRESETS = {
    "xgboost": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "maxBins": 64},
    "lightgbm": {"maxIter": 100, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 20,
                 "maxBins": 128},
}
# Names under which tuning files keep parameters, and Spark ML's. `None` as a depth or a share of features means no limit.
TUNED_NAMES = {
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                      "max_features": "featureSubsetStrategy", "bootstrap": "bootstrap"},
    "xgboost": {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
                "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain"},
    "lightgbm": {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate",
                 "min_child_samples": "minInstancesPerNode"},
}
DEEPEST = 30  # Spark's trees end there
F2_ON_ATTACK = dict(metricName="fMeasureByLabel", metricLabel=1.0, beta=2.0)


def input_stages(features: list[str], scaler: dict[str, tuple[float, float]] | None = None) -> list:
    """Scaling and selection as stages, so that a saved model carries its own feature list and scaler.

    The stages give inputs plain names, because feature names hold dots and slashes.
    """
    inputs = [f"{INPUT}{i}" for i in range(len(features))]
    cells = []
    for name, column in zip(features, inputs):
        centre, spread = (scaler or {}).get(name, (0.0, 1.0))
        quoted = "`" + name.replace("`", "``") + "`"
        cells.append(f"(cast({quoted} as double) - {float(centre)!r}D) / {float(spread)!r}D AS {column}")
    select = SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")
    return [select, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]


def training_table(df: DataFrame, features: list[str], label: str, extra: list[str] = (),
                   rows_per_partition: int = 2_000_000) -> DataFrame:
    """Features, `label` as double and the balanced `weight`.

    Training passes over the table dozens of times, so its slim rows are first
    dealt evenly: over all cores, or into more parts when the table is long.
    """
    slim = df.select(*[c(n) for n in features], c(label).cast("double").alias("label"), *[c(n) for n in extra])
    weights, classes = pin_small(class_weights(slim), MAX_CLASSES)
    if classes is None:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    parts = max(df.sparkSession.sparkContext.defaultParallelism,
                math.ceil(sum(r.n for r in classes) / rows_per_partition))
    return slim.repartition(parts).join(weights.drop("n"), "label")


def random_forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(weightCol="weight", **{"seed": 42, **params})


def boosted_trees(preset: str = "xgboost", validation: str | None = None, **params) -> GBTClassifier:
    """Boosted trees. With a boolean `validation` column, rounds stop once its loss no longer improves."""
    early = {"validationIndicatorCol": validation, "validationTol": 1e-4} if validation else {}
    return GBTClassifier(weightCol="weight", **{"seed": 42, **GBT_PRESETS[preset], **early, **params})


def train(df: DataFrame, features: list[str], label: str, learner, extra: list[str] = (),
          scaler: dict[str, tuple[float, float]] | None = None) -> PipelineModel:
    """The learner's model with its inputs. A forest bins and counts the rows first where rows of equal bins repeat; others take every row."""
    stages = input_stages(features, scaler)
    if isinstance(learner, RandomForestClassifier):
        model = forests.fit_grouped(df, stages[0], stages[1].getInputCols(), c(label), learner)
        if model is not None:
            return model
    return Pipeline(stages=[*stages, learner]).fit(training_table(df, features, label, extra))


@dataclass(frozen=True)
class Boosted:
    """A boosted model, the validation loss after each round that was made, the best round, and the one that ended the search."""

    model: PipelineModel
    losses: list[float]
    best_round: int
    stop_round: int


def train_boosted(df: DataFrame, features: list[str], label: str, validation: str, preset: str = "xgboost", rounds: int = MOST_ROUNDS,
                  patience: int = PATIENCE, scaler: dict[str, tuple[float, float]] | None = None, **params) -> Boosted:
    """Boosting that ends `patience` rounds after the best loss on the rows where `validation` is true.

    Rows are binned and counted first where rows of equal bins repeat, and the rounds are made one after the other on the groups. Other tables are
    fitted row by row. A round depends on its number and the rounds before it alone, so a longer fit begins with the rounds of a shorter one:
    fits of `patience` + 1, twice, four times, ... as many rounds are made until the loss has stood for `patience` rounds, and the model has the rounds up to the best one.
    """
    stages = input_stages(features, scaler)
    base = {"weightCol": "weight", "seed": 42, **GBT_PRESETS[preset], **params}
    learner = GBTClassifier(**base)
    with scratch(df.sparkSession):
        groups = boosting.counted_rows(df, stages[0], stages[1].getInputCols(), c(label), c(validation), learner.getMaxBins())
        if groups is not None:
            return Boosted(*boosting.fit_rounds(groups, learner, rounds, patience))
    table = stabilise(training_table(df, features, label, [validation]))  # the same rows in the same places for every fit
    prepare = PipelineModel(stages=stages)
    train, held = (prepare.transform(table.where(F.col(validation) == v)).select("features", "label", "weight") for v in (False, True))

    def fit(n: int):
        return GBTClassifier(**base | {"maxIter": n}).fit(train)

    made = min(patience + 1, rounds)  # no search ends before
    while True:
        fitted = fit(made)
        losses = fitted.evaluateEachIteration(held)
        best, stop = stopping(losses, patience)
        if stop is not None or made == rounds:
            break
        made = min(2 * made, rounds)
    final = fitted if best == made else fit(best)
    return Boosted(PipelineModel(stages=[*stages, final]), losses[:stop], best, stop or made)


def train_boosted_multiclass(df: DataFrame, features: list[str], label: str, **params) -> PipelineModel:
    """Boosted trees are binary in Spark ML, so several classes become one against the rest."""
    gbt = GBTClassifier(**{"seed": 42, **GBT_PRESETS["xgboost"], **params})
    rest = OneVsRest(classifier=gbt, weightCol="weight")
    return Pipeline(stages=[*input_stages(features), rest]).fit(training_table(df, features, label))


def forest_importance(df: DataFrame, features: list[str], label: str, **params) -> DataFrame:
    """`(feature, importance)` from a forest, largest first."""
    model = train(df, features, label, random_forest(**{**IMPORTANCE_FOREST, **params}))
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(
        list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def tuned_learner(model_type: str, best_params: dict):
    """The learner of a tuning run, and the names of its parameters that Spark has no counterpart for."""
    names = TUNED_NAMES[model_type]
    learner = random_forest() if model_type == "random_forest" else boosted_trees(model_type)
    known = {}
    for name, value in best_params.items():
        if name not in names:
            continue
        target = names[name]
        if target == "featureSubsetStrategy":
            known[target] = "all" if value in (None, "None") else str(value)
        elif target == "bootstrap":
            known[target] = value if isinstance(value, bool) else str(value).lower() == "true"
        elif target == "maxDepth":
            known[target] = DEEPEST if value in (None, "None") or int(value) < 0 else min(int(value), DEEPEST)
        elif target in ("stepSize", "subsamplingRate", "minInfoGain"):
            known[target] = float(value)
        else:
            known[target] = int(float(value))
    learner.setParams(**known)
    return learner, sorted(set(best_params) - set(names))


def draw_params(learner, space: dict, draws: int, seed: int = 42) -> list[dict]:
    """Seeded random parameter maps from a search space."""
    rng = random.Random(seed)

    def one(spec):
        if isinstance(spec, list):
            return rng.choice(spec)
        kind, low, high = spec
        if kind == "int":
            return rng.randint(low, high)
        return low * (high / low) ** rng.random() if kind == "log" else rng.uniform(low, high)

    return [{learner.getParam(name): one(spec) for name, spec in space.items()} for _ in range(draws)]


@dataclass(frozen=True)
class Searched:
    """What a search over counted groups found: the mean F2 of every draw, and the model of the best one over all rows."""

    avgMetrics: list[float]
    bestModel: PipelineModel


def search(df: DataFrame, features: list[str], label: str, learner, param_maps: list[dict], fold: str, folds: int,
           parallelism: int = 4):
    """Cross-validated search for the best F2 on the attack class, on precomputed folds.

    Forests are fitted and judged on rows that are binned and counted, once for each fold's training rows; rows that hardly repeat, and
    other learners, go through all rows for every fit.
    """
    if isinstance(learner, RandomForestClassifier):
        found = _search_groups(df, features, label, learner, param_maps, fold, folds)
        if found is not None:
            return found
    table = training_table(df, features, label, [fold])
    validator = CrossValidator(
        estimator=Pipeline(stages=[*input_stages(features), learner]), estimatorParamMaps=param_maps,
        evaluator=MulticlassClassificationEvaluator(**F2_ON_ATTACK), numFolds=folds, foldCol=fold,
        parallelism=parallelism)
    return validator.fit(table)


def _search_groups(df: DataFrame, features: list[str], label: str, learner, param_maps: list[dict], fold: str, folds: int) -> Searched | None:
    """The search over counted groups; None where rows hardly repeat. Classes are few (checked)."""
    stages = input_stages(features)
    columns, y = stages[1].getInputCols(), c(label)
    df = df.where(y.isNotNull())
    if pin_small(df.select(y.cast("double").alias("label")).distinct(), MAX_CLASSES)[1] is None:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    learners = [learner.copy(m) for m in param_maps]
    evaluator = MulticlassClassificationEvaluator(weightCol="n", **F2_ON_ATTACK)  # a group counts as its rows
    metrics = [[] for _ in learners]
    for i in range(folds):
        fitting, held = df.where(c(fold) != i), df.where(c(fold) == i)
        for most in sorted({x.getMaxBins() for x in learners}):
            groups = forests.counted_rows(fitting, stages[0], columns, y, most)
            if groups is None:
                return None
            judged = forests.counted_like(held, groups, columns, y)
            for n, one in enumerate(learners):
                if one.getMaxBins() == most:
                    model = forests.fit_groups(groups, one)
                    scored = PipelineModel(stages=model.stages[2:]).transform(judged)
                    metrics[n].append(evaluator.evaluate(scored))
    means = [sum(m) / folds for m in metrics]
    best = max(range(len(means)), key=lambda n: (means[n], -n))
    return Searched(means, train(df, features, label, learners[best]))


def search_results(df: DataFrame, fitted, param_maps: list[dict]) -> DataFrame:
    """`(rank, params, mean_f2)` of a finished search."""
    scored = sorted(zip(fitted.avgMetrics, range(len(param_maps))), key=lambda t: (-t[0], t[1]))
    rows = [(i, ", ".join(f"{p.name}={v}" for p, v in sorted(param_maps[n].items(), key=lambda kv: kv[0].name)), float(s))
            for i, (s, n) in enumerate(scored, 1)]
    return df.sparkSession.createDataFrame(rows, "rank int, params string, mean_f2 double")


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds `prediction` (int) and `confidence`, the largest class probability.

    Where a model sees bins, a table's rows of equal bins are scored once and joined with the result; a stream is scored row by row.
    """
    binning = [i for i, stage in enumerate(model.stages) if isinstance(stage, Bucketizer)]
    if binning and not df.isStreaming:
        at = binning[-1]
        bins = model.stages[at].getOutputCols()
        binned = PipelineModel(stages=model.stages[:at + 1]).transform(df).select(*[c(n) for n in df.columns], *bins)
        cells = _scored_rows(binned.select(*bins).distinct(), PipelineModel(stages=model.stages[at + 1:]))
        return binned.join(cells, bins, "left").select(*[c(n) for n in df.columns], "prediction", "confidence")
    return _scored_rows(df, model)


def _scored_rows(df: DataFrame, model: PipelineModel) -> DataFrame:
    out = model.transform(df)
    if "probability" in out.columns:
        confidence = F.array_max(vector_to_array("probability"))
    else:  # one model against the rest for each class: their logistic margins, scaled to one
        shares = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        confidence = F.array_max(shares) / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    drop = [n for n in out.columns if n not in df.columns and n != "prediction"]
    return out.withColumns({"prediction": F.col("prediction").cast("int"), "confidence": confidence}).drop(*drop)


def save_version(model: PipelineModel, root: str, model_type: str, version_id: str, registry_row: dict) -> str:
    """Save a model under `root/models/type/version` and append its row to the version registry."""
    from ..sources.registries import VERSION_SCHEMA

    path = f"{root}/models/{model_type}/{version_id}"
    model.write().overwrite().save(path)
    row = {"model_type": model_type, "version_id": version_id, "model_path": path, "created_at": time.time(), **registry_row}
    SparkSession.active().createDataFrame([row], VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return path


def load_version(root: str, model_type: str, version_id: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{model_type}/{version_id}")
