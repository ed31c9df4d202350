"""Feature statistics fitted on a training table: filters, scalers, importances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, is_infinite, is_missing, pearson, unpivot_features
from ..functions.quantiles import exact_quantiles
from .labels import binary_label

#: Below this share of its square sum, a column's spread inside a pair is rounding noise.
CONSTANT = 1e-12


def variances(df: DataFrame, names: list[str]) -> DataFrame:
    """`(feature, variance)`, population variance."""
    wide = df.agg(*[F.var_pop(c(n).cast("double")).alias(n) for n in names])
    return unpivot_features(wide, [], names, value_col="variance")


def variance_filter(df: DataFrame, names: list[str], threshold: float = 0.0) -> list[str]:
    """Features whose variance on this table exceeds the threshold, in order."""
    kept = {r.feature for r in variances(df, names).where(F.col("variance") > threshold).collect()}
    return [n for n in names if n in kept]


def correlation_matrix(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r for every pair i < j over the rows where both have a value; None where it is undefined.

    A first pass standardises the columns. One distributed product of the values, their
    squares and flags of presence then holds every sum that a pair needs, gaps included.
    """
    plain = df.select(*[F.when(~is_missing(c(n).cast("double")), c(n).cast("double")).alias(f"f{i}") for i, n in enumerate(names)])
    first = plain.agg(*[f(f"f{i}").alias(f"{tag}{i}") for i in range(len(names))
                        for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    varies = [i for i in range(len(names)) if first[f"s{i}"] and math.isfinite(first[f"s{i}"])]
    values = dict.fromkeys((a, b) for j, b in enumerate(names) for a in names[:j])
    if len(varies) < 2:
        return values
    standard = plain.select(*[((F.col(f"f{i}") - first[f"m{i}"]) / first[f"s{i}"]).alias(f"f{i}") for i in varies])
    cells = [F.coalesce(x, F.lit(0.0)) for i in varies for x in (
        F.col(f"f{i}"), F.col(f"f{i}") * F.col(f"f{i}"), F.col(f"f{i}").isNotNull().cast("double"))]
    wide = standard.select(*[x.alias(f"c{k}") for k, x in enumerate(cells)])
    vectors = VectorAssembler(inputCols=wide.columns, outputCol="v").transform(wide).select("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    value, square, there = (slice(k, None, 3) for k in range(3))
    n, total, squares = gram[there, there], gram[value, there], gram[square, there]
    spread = n * squares - total * total  # of the row's column, over the rows where the other one has a value
    spread[~(spread > CONSTANT * n * squares)] = np.nan
    r = (n * gram[value, value] - total * total.T) / np.sqrt(spread * spread.T)
    for q, j in enumerate(varies):
        for p, i in enumerate(varies[:q]):
            if math.isfinite(r[p, q]):
                values[names[i], names[j]] = float(np.clip(r[p, q], -1.0, 1.0))
    return values


def correlation_table(df: DataFrame, names: list[str]) -> DataFrame:
    rows = [(a, b, r) for (a, b), r in correlation_matrix(df, names).items()]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def correlation_filter(df: DataFrame, names: list[str], threshold: float = 0.95) -> list[str]:
    """Drop a feature when any earlier one, kept or dropped, correlates above the threshold."""
    r = correlation_matrix(df, names)
    dropped = {b for (_, b), v in r.items() if v is not None and abs(v) > threshold}
    return [n for n in names if n not in dropped]


def reduction_summary(df: DataFrame, names: list[str], variance_threshold: float = 0.0,
                      correlation_threshold: float = 0.95) -> DataFrame:
    """One row per feature: at which step it was removed, or that it was kept."""
    varying = variance_filter(df, names, variance_threshold)
    kept = correlation_filter(df, varying, correlation_threshold)
    rows = [(n, "variance" if n not in varying else "correlation" if n not in kept else "kept") for n in names]
    return df.sparkSession.createDataFrame(rows, "feature string, outcome string")


# --------------------------------------------------------------------------- scaling

def fit_robust_scaler(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per feature; a range of 0 counts as 1."""
    q = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    out = {}
    for n in names:
        low, middle, high = q[n]
        spread = 0.0 if low is None else high - low
        out[n] = (middle or 0.0, spread if spread != 0 else 1.0)
    return out


def fit_standard_scaler(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per feature; a deviation of 0 counts as 1."""
    row = df.agg(*[f(c(n).cast("double")).alias(f"{tag}{i}") for i, n in enumerate(names)
                   for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {n: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, n in enumerate(names)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply a fitted scaler: its numbers are literals in one projection."""
    return df.withColumns({
        n: (c(n).cast("double") - F.lit(centre)) / F.lit(spread) for n, (centre, spread) in scaler.items()})


# --------------------------------------------------------------------------- importances

def quick_importance(df: DataFrame, names: list[str], label: str = "Label") -> DataFrame:
    """`0.7 |corr(x, label)| + 0.3 min(var / max(x)^2, 1)` per feature, largest first."""
    zeroed = df.select(binary_label(c(label)).cast("double").alias("_y"), *[
        F.when(is_infinite(c(n)) | is_missing(c(n)), 0.0).otherwise(c(n).cast("double")).alias(n) for n in names])
    stats = zeroed.agg(*[
        F.struct(
            F.lit(n).alias("feature"), pearson(c(n), F.col("_y")).alias("r"),
            F.var_pop(c(n)).alias("v"), F.max(F.abs(c(n))).alias("top"),
        ).alias(f"s{i}") for i, n in enumerate(names)
    ])
    long = stats.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))
    r = F.coalesce(F.abs("r"), F.lit(0.0))
    spread = F.when(F.col("top") > 0, F.col("v") / (F.col("top") * F.col("top"))).otherwise(0.0)
    return long.select("feature", (r * 0.7 + F.least(spread, F.lit(1.0)) * 0.3).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def top_features(importances: DataFrame, k: int = 30) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
