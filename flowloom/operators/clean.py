"""Cleaning of labelled flow tables: schema, missing and infinite values, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES, ID_COLUMNS, LABEL_COLUMNS, LABEL_SPELLINGS
from ..functions.columns import any_of, c, is_infinite, is_missing, numeric_columns


def drop_identifiers(df: DataFrame, names: list[str] = ID_COLUMNS) -> DataFrame:
    present = set(df.columns)
    return df.drop(*[c(n) for n in names if n in present])


def normalise_label(df: DataFrame) -> DataFrame:
    """Rename the label column, whichever accepted spelling it has, to `Label`."""
    for name in LABEL_SPELLINGS:
        if name in df.columns:
            return df if name == "Label" else df.withColumnRenamed(name, "Label")
    raise KeyError("no label column found")


def has_infinite(df: DataFrame, names: list[str] | None = None) -> Column:
    return any_of([is_infinite(c(n)) for n in (names or numeric_columns(df))])


def drop_infinite_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.where(~has_infinite(df, names))


def fill_missing(df: DataFrame, value: float = 0.0, names: list[str] | None = None) -> DataFrame:
    return df.withColumns({
        n: F.when(is_missing(c(n)), F.lit(value).cast(df.schema[n].dataType)).otherwise(c(n))
        for n in (names or numeric_columns(df))
    })


def serving_clean(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The scoring path keeps rows: infinite and missing values become 0."""
    return df.withColumns({
        n: F.when(is_infinite(c(n)) | is_missing(c(n)), F.lit(0).cast(df.schema[n].dataType)).otherwise(c(n))
        for n in (names or numeric_columns(df))
    })


def coerce_numeric(df: DataFrame, names: list[str], value: float = 0.0) -> DataFrame:
    """Read text as doubles; what is not a number becomes `value`."""
    parsed = df.withColumns({n: c(n).cast("string").try_cast("double") for n in names})
    return fill_missing(parsed, value, names)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates, after identifiers are gone. Copies collapse on the map side first."""
    return df.dropDuplicates()


def clean(df: DataFrame, id_columns: list[str] = ID_COLUMNS, value: float = 0.0,
          deduplicate: bool = True) -> DataFrame:
    """Drop identifiers, drop rows with infinities, fill missing values, drop duplicates."""
    out = normalise_label(drop_identifiers(df, id_columns))
    out = fill_missing(drop_infinite_rows(out), value)
    return remove_duplicates(out) if deduplicate else out


def cleaning_audit(df: DataFrame, id_columns: list[str] = ID_COLUMNS, value: float = 0.0) -> DataFrame:
    """Rows in, rows with infinities, missing cells filled, duplicates, rows out: one table, one pass.

    Every row is reduced to its cleaned content with a count per content, so the
    copies of a row never meet in one task.
    """
    trimmed = normalise_label(drop_identifiers(df, id_columns))
    numbers = numeric_columns(trimmed)
    bad = has_infinite(trimmed, numbers)
    missing = sum((is_missing(c(n)).cast("long") for n in numbers), F.lit(0).cast("long"))
    marked = fill_missing(trimmed.withColumns({"_bad": bad, "_missing": F.when(~bad, missing).otherwise(0)}),
                          value, numbers)
    per_content = marked.groupBy(*[c(n) for n in trimmed.columns], "_bad").agg(
        F.count("*").alias("_n"), F.sum("_missing").alias("_filled"))
    good = ~F.col("_bad")
    return per_content.agg(
        F.sum("_n").alias("rows_in"),
        F.coalesce(F.sum(F.when(F.col("_bad"), F.col("_n"))), F.lit(0)).alias("infinite_rows"),
        F.sum("_filled").alias("filled_cells"),
        F.coalesce(F.sum(F.when(good, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(good).alias("rows_out"),
    )


def find_column(columns: list[str], *names: str) -> str | None:
    """The first of `names` among `columns`, ignoring case and outer spaces."""
    known = {n.strip().lower(): n for n in columns}
    return next((known[n.strip().lower()] for n in names if n.strip().lower() in known), None)


def align(df: DataFrame, expected: list[str] = FEATURES, keep: list[str] = ()) -> DataFrame:
    """The expected columns in order; absent ones are 0.0, text that is no number is NULL. `keep` columns come first."""
    def pick(name: str) -> Column:
        actual = find_column(df.columns, name)
        return (c(actual).try_cast("double") if actual is not None else F.lit(0.0)).alias(name)

    return df.select(*[c(k) for k in keep], *[pick(n) for n in expected])


def feature_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in LABEL_COLUMNS]


def select_features(df: DataFrame, selected: list[str], keep: list[str] = ()) -> DataFrame:
    """Selected features in the order of the list, resolved ignoring case; an absent one is an error."""
    resolved = {n: find_column(feature_columns(df), n) for n in selected}
    absent = [n for n, actual in resolved.items() if actual is None]
    if absent:
        raise KeyError(f"missing features: {absent}")
    return df.select(*[c(k) for k in keep], *[c(actual).alias(n) for n, actual in resolved.items()])


def select_by_index(df: DataFrame, scaled: list[str], selected: list[str]) -> DataFrame:
    """Selection by position in the scaler's column list; unknown names are skipped."""
    positions = {n.lower(): i for i, n in enumerate(scaled)}
    return df.select(*[c(scaled[positions[n.lower()]]) for n in selected if n.lower() in positions])


def model_ready(df: DataFrame, selected: list[str], target: str = "Label_Binary") -> DataFrame:
    out = select_features(df, selected, keep=[target])
    return out.select(*[c(n) for n in selected], c(target).alias("target"))


def check_contract(df: DataFrame, required: list[str] = (), min_rows: int = 1) -> list[str]:
    """Problems with a table, empty when it has the required columns and enough rows."""
    problems = [f"missing column: {n}" for n in required if n not in df.columns]
    if len(df.select(F.lit(1)).take(min_rows)) < min_rows:
        problems.append(f"fewer than {min_rows} rows")
    return problems


def union_files(tables: list[DataFrame]) -> DataFrame:
    """One table over many; columns absent from some become missing values."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def column_contract(headers: DataFrame, expected: list[str] = FEATURES) -> DataFrame:
    """`(file, position, name)` of many files against the expected feature list.

    One row per file and deviating feature: `missing`, `extra`, or `out_of_order`
    when the feature's rank among the file's expected features differs.
    """
    from pyspark.sql import Window as W

    spark = headers.sparkSession
    want = F.broadcast(spark.createDataFrame(  # one row per expected feature
        [(n, i) for i, n in enumerate(expected)], "name string, want int"))
    have = headers.select("file", "position", F.trim("name").alias("name"))
    matched = have.join(want, "name", "left")
    w = W.partitionBy("file")  # a header, not data: bounded by the number of columns
    ranked = matched.withColumns({
        "rank_have": F.count("want").over(w.orderBy("position")),
        "rank_want": F.count("want").over(w.orderBy(F.asc_nulls_last("want"))),
    })
    found = ranked.select("file", "name", F.when(F.col("want").isNull(), "extra").when(
        F.col("rank_have") != F.col("rank_want"), "out_of_order").alias("problem")).where("problem is not null")
    missing = (
        have.groupBy("file").agg(F.collect_set("name").alias("names"))
        .select("file", F.explode(F.array_except(F.array(*map(F.lit, expected)), "names")).alias("name"),
                F.lit("missing").alias("problem"))
    )
    return found.unionByName(missing)
