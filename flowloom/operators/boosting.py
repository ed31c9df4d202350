"""Boosted trees over rows that were binned and counted first.

Trees see a feature only through its bins, so rows with equal bins and label have one gradient and are one row with a count. The groups of a
table are bounded by its bins, whatever its length. Each round fits one of Spark ML's regression trees to the gradients of the groups; a row
enters a round with a fixed probability, so n rows enter it Binomial(n, probability) times together. Rounds follow each other until
the loss on held-out rows stands still, and none is made twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import forget, stabilise
from . import forests

ROWS_PER_GROUP = 1.25  # with fewer rows a group on average, rows are fitted as they are; rounds are many, so a few copies pay already
STORED_EVERY = 20  # rounds after which the margins of the groups are stored
HELD = "_held_"


def stopping(losses: list[float], patience: int) -> tuple[int, int | None]:
    """The best round (from 1) before the first `patience` rounds without a better one, and the round at which these end, if they do."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best] or i == 0:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, None


def binomial(n: np.ndarray, rate: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial numbers from two uniform ones each: by the distribution function up to a mean of 50, by its normal expansion above.

    The rarer of the two outcomes is counted.
    """
    p = min(rate, 1 - rate)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out = np.clip(np.rint(n * p + np.sqrt(n * p * (1 - p)) * z + (1 - 2 * p) * (z * z - 1) / 6), 0, n)
    small = n * p <= 50
    m, x = n[small], u[small]
    term = (1 - p) ** m
    total, k, i = term.copy(), np.zeros(len(m)), 0
    while True:
        more = (x > total) & (m > i)
        if not more.any():
            break
        term = term * (m - i) / (i + 1) * (p / (1 - p))
        i += 1
        k[more] = i
        total += term
    out[small] = k
    return out if p == rate else n - out


def _drawn(rate: float):
    @F.pandas_udf(T.DoubleType())
    def drawn(n: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(binomial(n.to_numpy(float), rate, u.to_numpy(float), v.to_numpy(float)))

    return drawn.asNondeterministic()  # not so, but a filter on it is then not a second call


@dataclass(frozen=True)
class Counted:
    """Rows of equal bins and label: `(key, features, y, weight, n, held, margin)`, with the stages that lead to the bins.

    `y` is -1 or 1, `weight` that of a row of the class, `n` counts the rows to fit and `held` those that end the rounds.
    """

    select: object
    bins: Bucketizer
    assembler: VectorAssembler
    table: DataFrame
    weights: dict[float, float]


def counted_rows(df: DataFrame, select, columns: list[str], label: Column, held: Column, max_bins: int) -> Counted | None:
    """The groups that rounds are fitted on; None where rows hardly repeat. The bins are those of the rows to fit."""
    marked = df.withColumns({"label": label.cast("double"), HELD: held}).where(F.col("label").isNotNull() & F.col(HELD).isNotNull())
    plain = select.transform(marked).select("label", HELD, *columns)
    bins = forests.binning(plain.where(~F.col(HELD)), columns, max_bins)
    binned = bins.getOutputCols()
    # Bins are marked as categories, of which trees would take any subset; a sum has no mark, so bins are ordered as their values are.
    rows = bins.transform(plain).select("label", HELD, *[(F.col(n) + 0.0).alias(n) for n in binned])
    count, groups = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*binned, "label"), 0.02)).first()
    if not count or count < ROWS_PER_GROUP * groups:
        return None
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(groups / forests.GROUPS_PER_PARTITION))
    counted = stabilise(rows.groupBy(*binned, "label").agg(
        F.count_if(~F.col(HELD)).alias("n"), F.count_if(F.col(HELD)).alias("held")).repartition(parts, *binned, "label"))
    classes = counted.groupBy("label").agg(F.sum(F.col("n") + F.col("held")).alias("n")).limit(3).collect()
    if not {r.label for r in classes} <= {0.0, 1.0}:
        raise ValueError("boosted trees tell classes 0 and 1 apart; there are others")
    weights = {r.label: sum(x.n for x in classes) / (len(classes) * r.n) for r in classes}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("label"))
    assembler = VectorAssembler(inputCols=binned, outputCol="features", handleInvalid="error")
    table = stabilise(assembler.transform(counted).select(
        F.xxhash64(*binned, "label").alias("key"), "features", (2 * F.col("label") - 1).alias("y"), weight.alias("weight"),
        F.col("n").cast("double").alias("n"), F.col("held").cast("double").alias("held"), F.lit(0.0).alias("margin")))
    return Counted(select, bins, assembler, table, weights)


def _target(number: int) -> Column:
    """What a round is fitted to: the class at first, then the negative gradient of Spark's logistic loss."""
    y, margin = F.col("y"), F.col("margin")
    return y if number == 0 else 4 * y / (1 + F.exp(2 * y * margin))


def _tree_learner(counted: Counted, learner: GBTClassifier) -> RandomForestRegressor:
    """One regression tree with the learner's settings.

    `minInstancesPerNode` rows are taken at the weight of a row of the rarer class, so no leaf has fewer rows than that, and leaves of the other have more.
    """
    shared = ("maxDepth", "maxBins", "minInfoGain", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval", "featureSubsetStrategy")
    least, fraction = learner.getMinInstancesPerNode(), learner.getMinWeightFractionPerNode()
    if least > 1:
        entering = counted.table.agg(F.sum(F.col("n") * F.col("weight"))).first()[0] * learner.getSubsamplingRate()
        fraction = max(fraction, min(0.499, least * max(counted.weights.values()) / entering))
    return RandomForestRegressor(numTrees=1, bootstrap=False, weightCol="weight", minWeightFractionPerNode=fraction,
                                 **{name: learner.getOrDefault(name) for name in shared})


def fit_rounds(counted: Counted, learner: GBTClassifier, rounds: int, patience: int,
               stop: Callable[[list[float], int], tuple[int, int | None]] = stopping) -> tuple[PipelineModel, list[float], int, int]:
    """The model up to the best round, the loss on the held rows after each round, the best round and the last one.

    Losses are taken when the search may end first, all in one pass.
    """
    base, rate, step, seed = _tree_learner(counted, learner), learner.getSubsamplingRate(), learner.getStepSize(), learner.getSeed()
    held = counted.table.where("held > 0").select("features", ((F.col("y") + 1) / 2).alias("label"), (F.col("held") * F.col("weight")).alias("weight"))
    stored, drawn, columns = counted.table, _drawn(rate), counted.table.columns
    trees, sizes, kept, due = [], [], 0, min(patience + 1, rounds)  # the stored margins have the first `kept` trees
    while True:
        number = len(trees)
        state = _with_margin(stored, trees[kept:], sizes[kept:], learner)
        if number - kept == STORED_EVERY:
            before, stored, kept = stored, stabilise(state.select(*columns)), number
            if before is not counted.table:  # which is read for the losses
                forget(before)
            state = stored
        u, v = (forests._uniform("key", F.lit(f"{seed} {number} {x}")) for x in "uv")
        times = drawn("n", u, v) if rate < 1 else F.col("n")
        rows = state.where("n > 0").select("features", _target(number).alias("label"), "weight", times.alias("times"))
        rows = rows.where("times > 0").select("features", "label", (F.col("times") * F.col("weight")).alias("weight"))
        rows = rows.persist()  # a fit reads its rows several times; executors that are lost draw them again
        try:
            trees.append(base.copy({base.seed: seed + number}).fit(rows).trees[0])
        finally:
            rows.unpersist()
        sizes.append(step if number else 1.0)
        if len(trees) == due:
            losses = _together(trees, sizes, learner).evaluateEachIteration(held)
            best, stopped = stop(losses, patience)
            if stopped is not None or due == rounds:
                break
            due = min(best + patience, rounds)
    model = _together(trees[:best], sizes[:best], learner)
    return PipelineModel(stages=[counted.select, counted.bins, counted.assembler, model]), losses, best, len(trees)


def _with_margin(stored: DataFrame, trees: list, sizes: list[float], learner: GBTClassifier) -> DataFrame:
    """The groups with the trees that came since in their margins."""
    if not trees:
        return stored
    since = _together(trees, sizes, learner).setPredictionCol("").setProbabilityCol("").setRawPredictionCol("_since")
    return since.transform(stored).withColumn("margin", F.col("margin") + F.get(vector_to_array("_since"), F.lit(1)))


def _together(trees: list, weights: list[float], learner: GBTClassifier) -> GBTClassificationModel:
    """One boosted model of its rounds' trees."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    of_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    of_weights = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        of_trees[i], of_weights[i] = tree._java_obj, weight
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(learner.uid, of_trees, of_weights, trees[0].numFeatures, 2)
    learner._transfer_params_to_java()
    return GBTClassificationModel(java.copy(learner._java_obj.extractParamMap()))
