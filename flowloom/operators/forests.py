"""Random forests over rows that were binned and counted first.

A forest's trees see a feature only through its bins, so rows with equal bins and label are one row with a count. The groups of a table are
bounded by its bins, whatever its length, and each tree draws how often the rows of a group enter it: a row enters a bootstrap
Poisson(1) times, so n rows enter it Poisson(n) times together. The trees are Spark ML's, fitted one at a time on the drawn weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounded import stabilise

POINTS = 1_000  # ranks of a feature at which bins may end
ROWS_PER_GROUP = 2  # with fewer rows a group on average, rows are fitted as they are
GROUPS_PER_PARTITION = 100_000
BIN = "_bin_"


def bin_edges(points: list[float], bins: int) -> list[float]:
    """Inner edges of at most `bins` bins from evenly spaced ranks' values, smallest and largest included.

    A value that fills a bin gets its own; the others share the bins that are left.
    """
    values, counts = np.unique(np.asarray(points, float), return_counts=True)
    if len(values) <= bins:
        starts = values[1:]
    else:
        starts, held, left, open_bins = [], 0, counts.sum(), bins
        for value, n in zip(values, counts):
            if held and open_bins > 1 and (held + n / 2) * open_bins > left:
                starts.append(value)
                left, open_bins, held = left - held, open_bins - 1, 0
            held += n
    return [float(v) for v in starts if np.isfinite(v)]


def binning(df: DataFrame, names: list[str], bins: int) -> Bucketizer:
    """The bins of every column, from two bounded summaries a column."""
    ranks = [i / POINTS for i in range(POINTS + 1)]
    points = df.approxQuantile(names, ranks, 0.25 / POINTS)
    splits = [[-float("inf"), *(bin_edges(p, bins) or [0.0]), float("inf")] for p in points]  # Spark wants an inner edge
    return Bucketizer(inputCols=names, outputCols=[f"{BIN}{i}" for i in range(len(names))], splitsArray=splits)


def poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Poisson numbers from two uniform ones each: by the distribution function up to a mean of 50, by its normal expansion above."""
    small = mean <= 50
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out = np.maximum(np.rint(mean + np.sqrt(mean) * z + (z * z - 1) / 6), 0)
    m, x = mean[small], u[small]
    term = np.exp(-m)
    total, k = term.copy(), np.zeros(len(m))
    for i in range(1, 150):
        more = x > total
        if not more.any():
            break
        k[more] = i
        term = term * m / i
        total += term
    out[small] = k
    return out


@F.pandas_udf(T.DoubleType())
def _drawn(mean: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series(poisson(mean.to_numpy(float), u.to_numpy(float), v.to_numpy(float)))


def _uniform(*of) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 11) + F.lit(0.5)) / F.lit(float(2**53))


def grouped(prepared: DataFrame, binned: list[str]) -> DataFrame | None:
    """`(bins, label, n)` of `(bins, label)`, stored; None where rows hardly repeat."""
    rows, groups = prepared.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*binned, "label"), 0.02)).first()
    if not rows or rows < ROWS_PER_GROUP * groups:
        return None
    counted = prepared.groupBy(*binned, "label").agg(F.count("*").alias("n"))
    return stabilise(counted.repartition(max(1, round(groups / GROUPS_PER_PARTITION)), *binned))


@dataclass(frozen=True)
class Groups:
    """Rows of equal bins and label, counted, with the stages that lead to the bins and the rows of each class."""

    select: object
    bins: Bucketizer
    table: DataFrame
    classes: dict[float, int]


def _labelled(df: DataFrame, select, columns: list[str], label: Column) -> DataFrame:
    return select.transform(df.withColumn("label", label.cast("double"))).select("label", *columns)


def counted_rows(df: DataFrame, select, columns: list[str], label: Column, max_bins: int) -> Groups | None:
    """The groups that forests are fitted on; None where rows hardly repeat."""
    plain = _labelled(df, select, columns, label)
    bins = binning(plain, columns, max_bins)
    binned = bins.getOutputCols()
    groups = grouped(bins.transform(plain).select("label", *binned), binned)
    if groups is None:
        return None
    classes = {r.label: r.n for r in groups.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # checked by the caller
    return Groups(select, bins, groups, classes)


def counted_like(df: DataFrame, groups: Groups, columns: list[str], label: Column) -> DataFrame:
    """`(bins, label, n)` of other rows in the bins of `groups`, stored."""
    binned = groups.bins.getOutputCols()
    return stabilise(groups.bins.transform(_labelled(df, groups.select, columns, label)).groupBy(*binned, "label").agg(F.count("*").alias("n")))


def fit_grouped(df: DataFrame, select, columns: list[str], label: Column, learner: RandomForestClassifier,
                parallelism: int = 8) -> PipelineModel | None:
    """The forest as a pipeline of `select`, the bins and Spark's forest; None where rows hardly repeat. `select` gives the numbers their names in `columns`."""
    groups = counted_rows(df, select, columns, label, learner.getMaxBins())
    return None if groups is None else fit_groups(groups, learner, parallelism)


def fit_groups(counted: Groups, learner: RandomForestClassifier, parallelism: int = 8) -> PipelineModel:
    """The forest of counted groups. Classes weigh the same.

    `minInstancesPerNode` rows are taken at the weight of a row of the rarest class, so no leaf has fewer rows than that (a hundredth or so
    apart, as bootstraps differ in size), and leaves of the other classes have more.
    """
    groups, classes, binned = counted.table, counted.classes, counted.bins.getOutputCols()
    rows = sum(classes.values())
    weights = {k: rows / (len(classes) * n) for k, n in classes.items()}
    weight = F.element_at(F.create_map(*[F.lit(float(x)) for kv in weights.items() for x in kv]), F.col("label"))
    assembler = VectorAssembler(inputCols=binned, outputCol="features", handleInvalid="error")
    seed, trees, rate = learner.getSeed(), learner.getNumTrees(), learner.getSubsamplingRate()
    strategy = learner.getFeatureSubsetStrategy()
    least = learner.getMinInstancesPerNode()
    settings = {
        "numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "minInstancesPerNode": 1,
        "featureSubsetStrategy": "sqrt" if strategy == "auto" and trees > 1 else strategy,
        "minWeightFractionPerNode": min(0.499, least * max(weights.values()) / (rows * rate)) if least > 1 else 0.0}

    def fit(number: int):
        if learner.getBootstrap():
            times = _drawn(F.col("n") * F.lit(rate), _uniform(*binned, "label", F.lit(f"{seed} {number} u")),
                           _uniform(*binned, "label", F.lit(f"{seed} {number} v")))
        else:
            times = F.col("n")
        drawn = assembler.transform(groups.withColumn("times", times)).where("times > 0").select(
            "features", "label", (F.col("times") * weight).alias("weight"))
        one = learner.copy()
        one.setParams(**settings, seed=seed + number)
        drawn = drawn.persist()  # a fit reads its rows several times; executors that are lost draw them again
        try:
            return one.fit(drawn)
        finally:
            drawn.unpersist()

    with ThreadPool(min(parallelism, trees)) as pool:
        fitted = pool.map(inheritable_thread_target(groups.sparkSession)(fit), range(trees), chunksize=1)
    return PipelineModel(stages=[counted.select, counted.bins, assembler, _together(groups.sparkSession, fitted, learner)])


def _together(spark, fitted: list[RandomForestClassificationModel], learner) -> RandomForestClassificationModel:
    """One forest of the trees of several."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(fitted))
    for i, model in enumerate(fitted):
        trees[i] = model._java_obj.trees()[0]
    java = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        learner.uid, trees, fitted[0].numFeatures, fitted[0].numClasses)
    learner._transfer_params_to_java()
    return RandomForestClassificationModel(java.copy(learner._java_obj.extractParamMap()))
