"""The registry that ties a query name to its Spark plan and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c
from ..sources.bindings import spark_view, sql_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function `(spark, sf_dir) -> DataFrame`."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def over_view(name: str, view: str, sql: str | None = None):
    """Register a function of one bound view; the SQL may refer to the view by name."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark_view(spark, sf_dir, view))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(name, None if sql is None else f"with {sql_view(view)} {sql}")(run)
        return fn

    return register


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Sums and deviations of doubles depend on row order in the last bits; reports round them."""
    return df.withColumns({n: F.round(c(n), digits) for n in names})


def big(col: Column, name: str) -> Column:
    return col.cast("long").alias(name)
