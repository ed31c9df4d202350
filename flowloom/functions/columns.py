"""Column-level helpers. All of them stay inside Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """A column by exact name, including names with dots, slashes and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_infinite(col: Column) -> Column:
    return F.coalesce(F.abs(col) == F.lit(float("inf")), F.lit(False))


def is_missing(col: Column) -> Column:
    """NULL and NaN both mean "no value"; infinities do not."""
    return col.isNull() | F.isnan(col)


def finite(col: Column) -> Column:
    """The value, or NULL where it is NULL, NaN or infinite."""
    return F.when(~is_infinite(col) & ~is_missing(col), col)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """Division that yields `otherwise` when the denominator is zero or missing."""
    den = denominator.cast("double")
    return F.when(den.isNull() | (den == 0), F.lit(otherwise)).otherwise(numerator.cast("double") / den)


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio(precision * recall * (1 + b2), precision * b2 + recall)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows where both sides have a value; NULL when a side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def numeric_columns(df: DataFrame, skip: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def unpivot_features(df: DataFrame, keys: list[str], names: list[str],
                     name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Wide to long: one row per (keys, feature)."""
    cells = F.array(*[
        F.struct(F.lit(n).alias(name_col), c(n).cast("double").alias(value_col)) for n in names
    ])
    return df.select(*[c(k) for k in keys], F.inline(cells))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two one-row tables as one row, by union and not by a join without a key."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c(n)).alias(n) for n in both.columns])
