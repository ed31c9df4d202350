"""Data quality, drift and calibration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CALIBRATION_CATEGORIES, CRITICAL_FEATURES, DEFAULT_TOLERANCE, FEATURES, TOLERANCES
from ..constants import VALIDATION_CATEGORIES
from ..functions.columns import c, finite, pearson, ratio, unpivot_features
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import placed
from ..functions.running import with_running_totals
from .clean import find_column

# --------------------------------------------------------------------------- coverage


def coverage(df: DataFrame, selected: list[str] = FEATURES) -> DataFrame:
    """`(feature, present, critical)` for the wanted features; reads the schema only."""
    rows = [(n, find_column(df.columns, n) is not None, n in CRITICAL_FEATURES) for n in selected]
    return df.sparkSession.createDataFrame(rows, "feature string, present boolean, critical boolean")


def coverage_report(df: DataFrame, selected: list[str] = FEATURES) -> DataFrame:
    """Passed, missing and critical-missing counts, pass rate, label warning, verdict."""
    has_label = any("label" in n.lower() for n in df.columns)
    out = coverage(df, selected).agg(
        F.count("*").alias("total"), F.count_if("present").alias("passed"), F.count_if(~F.col("present")).alias("missing"),
        F.count_if(~F.col("present") & F.col("critical")).alias("critical_missing"))
    return out.withColumns({
        "pass_rate": ratio(F.col("passed"), F.col("total")) * 100, "label_found": F.lit(has_label),
    }).withColumn("is_valid", (F.col("pass_rate") >= 80) & (F.col("critical_missing") == 0))


def coverage_by_file(headers: DataFrame, selected: list[str] = FEATURES) -> DataFrame:
    """The same report for many files at once, from their `(file, name)` header rows."""
    wanted = F.broadcast(headers.sparkSession.createDataFrame(  # one row per wanted feature
        [(n.strip().lower(), n in CRITICAL_FEATURES) for n in selected], "known string, critical boolean"))
    total, total_critical = len(selected), sum(n in CRITICAL_FEATURES for n in selected)
    names = headers.select("file", F.lower(F.trim("name")).alias("known")).distinct()
    out = names.join(wanted, "known", "left").groupBy("file").agg(
        F.count("critical").alias("passed"), F.count_if("critical").alias("critical_found"))
    out = out.withColumns({
        "total": F.lit(total).cast("long"), "missing": F.lit(total) - F.col("passed"),
        "critical_missing": F.lit(total_critical) - F.col("critical_found"),
        "pass_rate": F.col("passed") * 100.0 / total})
    return out.drop("critical_found").withColumn(
        "is_valid", (F.col("pass_rate") >= 80) & (F.col("critical_missing") == 0))


# --------------------------------------------------------------------------- tolerances

def tolerance_table(df_or_spark, categories: dict = VALIDATION_CATEGORIES) -> DataFrame:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    rows = [(f, k, TOLERANCES[k]) for k, names in categories.items() for f in names]
    return spark.createDataFrame(rows, "feature string, category string, tolerance double")


def with_tolerance(df: DataFrame, categories: dict = VALIDATION_CATEGORIES, other: str = "other") -> DataFrame:
    """Adds `category` and `tolerance` by feature name."""
    table = F.broadcast(tolerance_table(df, categories))  # at most one row per feature
    return df.join(table, "feature", "left").withColumns({
        "category": F.coalesce("category", F.lit(other)),
        "tolerance": F.coalesce("tolerance", F.lit(DEFAULT_TOLERANCE))})


def calibration_tolerance(df: DataFrame) -> DataFrame:
    return with_tolerance(df, CALIBRATION_CATEGORIES, "default")


def relative_difference(expected: Column, actual: Column) -> Column:
    """|actual - expected| / |expected|; against 0 it is 1, or 0 when both are 0."""
    return F.when(expected != 0, F.abs(actual - expected) / F.abs(F.nullif(expected, F.lit(0.0)))).when(
        actual != 0, 1.0).otherwise(0.0)


def judged(pairs: DataFrame) -> DataFrame:
    """`(feature, expected, actual)` rows with difference, tolerance and verdict."""
    return _verdicts(with_tolerance(pairs))


def _verdicts(pairs: DataFrame) -> DataFrame:
    out = pairs.withColumns({
        "difference": F.abs(F.col("actual") - F.col("expected")),
        "relative_diff": relative_difference(F.col("expected"), F.col("actual"))})
    return out.withColumn("passed", F.col("relative_diff") <= F.col("tolerance"))


def feature_means(df: DataFrame, names: list[str], value_col: str = "mean") -> DataFrame:
    wide = df.agg(*[F.avg(finite(c(n).cast("double"))).alias(n) for n in names])
    return unpivot_features(wide, [], names, value_col=value_col)


def compare_means(expected: DataFrame, actual: DataFrame, names: list[str]) -> DataFrame:
    """Mean of every feature on both sides, compared within the tolerance of its category."""
    left, right = feature_means(expected, names, "expected"), feature_means(actual, names, "actual")
    return judged(left.join(right, "feature").where("expected is not null and actual is not null"))


def failed_features(results: DataFrame, k: int = 20) -> DataFrame:
    return results.where(~F.col("passed")).orderBy(F.desc(F.abs("relative_diff")), "feature").limit(k)


def critical_failures(results: DataFrame) -> DataFrame:
    critical = F.broadcast(results.sparkSession.createDataFrame([(n,) for n in CRITICAL_FEATURES], "feature string"))
    return results.where(~F.col("passed")).join(critical, "feature", "left_semi")


# --------------------------------------------------------------------------- flow by flow

def nearest_flows(extracted: DataFrame, labelled: DataFrame, partitions: int | None = None) -> DataFrame:
    """`(flow_key, id, start_us, labelled_id, labelled_start_us)`: for every extracted flow, the labelled flow of the same key with the nearest start.

    Flows of a key are never paired all with all, nor gathered in one task: both sides
    are laid out together in the order of time, a window inside each stretch of a key
    finds the neighbours on either side, and one row per stretch carries the neighbours
    across its ends.
    """
    def side(df, tag):
        spot = F.struct(F.col("start_us").alias("us"), F.col("id").alias("id"))
        return df.select("flow_key", "start_us", "id", F.lit(tag).alias("tag"), F.when(F.lit(tag == 0), spot).alias("spot"))

    order = ["start_us", "tag", "id"]
    both = placed(side(labelled, 0).unionByName(side(extracted, 1)), ["flow_key"], order, partitions)
    stretch = ["flow_key", "_part"]
    so_far, earlier = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, -1)
    inside, over_stretches = W.partitionBy(*stretch), W.partitionBy("flow_key")
    near = both.withColumns({
        "before": F.last("spot", ignorenulls=True).over(inside.orderBy("_place").rowsBetween(*so_far)),
        "after": F.last("spot", ignorenulls=True).over(inside.orderBy(F.desc("_place")).rowsBetween(*so_far)),
    }).where("tag = 1")
    ends = both.groupBy(*stretch).agg(F.min("spot").alias("first"), F.max("spot").alias("last")).select(
        *stretch,
        F.last("last", ignorenulls=True).over(over_stretches.orderBy("_part").rowsBetween(*earlier)).alias("prior"),
        F.last("first", ignorenulls=True).over(
            over_stretches.orderBy(F.desc("_part")).rowsBetween(*earlier)).alias("later"))

    both_near = near.join(ends, stretch).withColumns({
        "before": F.coalesce("before", "prior"), "after": F.coalesce("after", "later")})
    pick = F.when(
        F.col("after").isNull()
        | (F.col("start_us") - F.col("before.us") <= F.col("after.us") - F.col("start_us")), F.col("before"),
    ).otherwise(F.col("after"))
    return both_near.withColumn("pick", pick).where("pick is not null").select(
        "flow_key", "id", "start_us", F.col("pick.id").alias("labelled_id"), F.col("pick.us").alias("labelled_start_us"))


def match_flows(extracted: DataFrame, labelled: DataFrame, values: list[str] = (),
                partitions: int | None = None) -> DataFrame:
    """The nearest labelled flow of every extracted flow, with the values of either side as the structs `actual` and `expected`.

    Both sides are `(flow_key, start_us, id, *values)`, where `(flow_key, start_us, id)` names a flow; of two equally near
    flows the earlier wins. The values are joined to the matches by the names of both flows, so only names and times are sorted.
    """
    def side(df, tag):
        cells = F.struct(F.lit(0).alias("_"), *[c(n).cast("double").alias(f"v{i}") for i, n in enumerate(values)])
        return df.select(F.col("flow_key").alias(f"{tag}_key"), F.col("start_us").alias(f"{tag}_us"), F.col("id").alias(f"{tag}_id"), cells.alias(tag))

    found = nearest_flows(extracted, labelled, partitions)
    for df, tag, us, name in ((extracted, "actual", "start_us", "id"), (labelled, "expected", "labelled_start_us", "labelled_id")):
        found = found.join(side(df, tag), (F.col("flow_key") == F.col(f"{tag}_key")) & F.col(us).eqNullSafe(F.col(f"{tag}_us"))
                           & F.col(name).eqNullSafe(F.col(f"{tag}_id"))).drop(f"{tag}_key", f"{tag}_us", f"{tag}_id")
    return found


def compare_matched_flows(extracted: DataFrame, labelled: DataFrame, names: list[str]) -> DataFrame:
    """Feature-by-feature verdicts of every matched pair of flows, as a long table."""
    pairs = match_flows(extracted, labelled, names)
    known = {n: (k, TOLERANCES[k]) for k, own in VALIDATION_CATEGORIES.items() for n in own}  # a long row needs no join for these
    long = pairs.select("flow_key", "id", "labelled_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"expected.v{i}").alias("expected"), F.col(f"actual.v{i}").alias("actual"),
                 F.lit(known.get(n, ("other",))[0]).alias("category"),
                 F.lit(float(known.get(n, (None, DEFAULT_TOLERANCE))[1])).alias("tolerance"))
        for i, n in enumerate(names)])))
    return _verdicts(long.where("expected is not null and actual is not null").select(
        "feature", "flow_key", "id", "labelled_id", "expected", "actual", "category", "tolerance"))


# --------------------------------------------------------------------------- profiles

def feature_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation, minimum, maximum, median and zero share per feature, invalid values left out."""
    clean = df.select(*[finite(c(n).cast("double")).alias(n) for n in names])
    wide = clean.agg(*[
        F.struct(
            F.lit(n).alias("feature"), F.count(c(n)).alias("n"),
            F.coalesce(F.avg(c(n)), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(c(n)), F.lit(0.0)).alias("std"),
            F.coalesce(F.min(c(n)), F.lit(0.0)).alias("min"), F.coalesce(F.max(c(n)), F.lit(0.0)).alias("max"),
            ratio(F.count_if(c(n) == 0) * 100, F.count(c(n)), 100.0).alias("zero_pct"),
        ).alias(f"p{i}") for i, n in enumerate(names)
    ])
    medians = {n: q[0] or 0.0 for n, q in exact_quantiles(df, names, [0.5]).items()}
    table = F.broadcast(df.sparkSession.createDataFrame(list(medians.items()), "feature string, median double"))
    return wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(names))]))).join(table, "feature")


def calibration_score(df: DataFrame, expected: list[str] = FEATURES) -> DataFrame:
    """50 points for the share of features present, 50 for the share that varies."""
    present = {n: find_column(df.columns, n) for n in expected}
    found = [a for a in present.values() if a is not None]
    flat = [(F.coalesce(F.stddev_pop(finite(c(a).cast("double"))), F.lit(0.0)) == 0).cast("int") for a in found]
    total = len(expected)
    return df.agg(
        F.count("*").alias("n_samples"), F.lit(total).alias("total_features"),
        F.lit(total - len(found)).alias("missing_features"),
        sum(flat, F.lit(0)).alias("zero_variance_features"),
    ).withColumn("overall_score", (
        F.lit(len(found) * 50.0 / total) + (F.lit(len(found)) - F.col("zero_variance_features")) * 50.0 / total))


def calibration_findings(df: DataFrame, expected: list[str] = FEATURES) -> DataFrame:
    """`(kind, feature)` rows: missing, critical_missing and zero_variance features."""
    present = {n: find_column(df.columns, n) for n in expected}
    rows = [("missing", n) for n, a in present.items() if a is None]
    rows += [("critical_missing", n) for n, a in present.items() if a is None and n in CRITICAL_FEATURES]
    listed = df.sparkSession.createDataFrame(rows, "kind string, feature string")
    found = {n: a for n, a in present.items() if a is not None}
    if not found:
        return listed
    wide = df.agg(*[F.coalesce(F.stddev_pop(finite(c(a).cast("double"))), F.lit(0.0)).alias(n)
                    for n, a in found.items()])
    flat = unpivot_features(wide, [], list(found)).where("value = 0")
    return listed.unionByName(flat.select(F.lit("zero_variance").alias("kind"), "feature"))


# What a kind of finding means for the reader.
ADVICE = {
    "missing": "no file has this feature, so the model would see only zeros",
    "critical_missing": "the model depends on this feature and no file has it",
    "zero_variance": "every row has the same value, which tells a model nothing",
}


def calibration_messages(findings: DataFrame) -> DataFrame:
    """`(kind, severity, message)` rows for the findings."""
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return findings.select(
        "kind", F.when(F.col("kind") == "critical_missing", "critical").otherwise("advice").alias("severity"),
        F.concat(advice[F.col("kind")], F.lit(": "), "feature").alias("message"))


# --------------------------------------------------------------------------- drift

def drift_compare(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Mean and deviation of every feature in two samples, and their differences in percent."""
    def profile(df, tag):
        wide = df.agg(*[F.struct(
            F.lit(n).alias("feature"), F.avg(finite(c(n).cast("double"))).alias(f"mean_{tag}"),
            F.stddev_pop(finite(c(n).cast("double"))).alias(f"std_{tag}")).alias(f"p{i}")
            for i, n in enumerate(names)])
        return wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(names))])))

    def percent(stat):
        base, other = F.col(f"{stat}_a"), F.col(f"{stat}_b")
        return F.when(base != 0, F.abs((other - base) / F.nullif(base, F.lit(0.0))) * 100).when(
            other == 0, 0.0).otherwise(100.0)

    return profile(a, "a").join(profile(b, "b"), "feature").withColumns({
        "mean_diff_pct": percent("mean"), "std_diff_pct": percent("std")})


def paired_correlation(pairs: DataFrame, a: str, b: str, min_rows: int = 10) -> DataFrame:
    """Pearson r of two columns of one table, NULL with `min_rows` rows or fewer."""
    x, y = finite(c(a).cast("double")), finite(c(b).cast("double"))
    both = pairs.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return both.agg(F.when(F.count("*") > min_rows, pearson(F.col("x"), F.col("y"))).alias("correlation"))


KS_TERMS = 100


def ks_features(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov statistic of two samples for every feature, on all rows, with its asymptotic p-value.

    All features go through one pass: a row per feature and distinct value, and running totals within each feature.
    A feature without values on one side has the largest distance; without any, none.
    """
    def side(df, in_a):
        return unpivot_features(df, [], names, value_col="x").select(
            "feature", finite(F.col("x")).alias("x"), F.lit(in_a).alias("in_a"), F.lit(1 - in_a).alias("in_b")).where("x is not null")

    per_value = side(a, 1).unionByName(side(b, 0)).groupBy("feature", "x").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    curve = with_running_totals(per_value, "x", {"a": "cum_a", "b": "cum_b"}, groups=["feature"])
    gap = F.abs(ratio(F.col("cum_a"), F.col("all_cum_a")) - ratio(F.col("cum_b"), F.col("all_cum_b")))
    measured = curve.groupBy("feature").agg(F.max(gap).alias("ks_statistic"), F.max("all_cum_a").alias("n_a"), F.max("all_cum_b").alias("n_b"))
    listed = a.sparkSession.createDataFrame([(n,) for n in names], "feature string")  # the schema bounds it
    out = listed.join(measured, "feature", "left").fillna({"ks_statistic": 0.0, "n_a": 0, "n_b": 0})
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    z = F.col("ks_statistic") * F.sqrt(ratio(n * m, n + m))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(z * z * k * k * -2))
    return out.select("feature", "ks_statistic", F.when(z < 0.2, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))).alias("ks_pvalue"), "n_a", "n_b")


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The statistic for one column, on one row."""
    return ks_features(a, b, [value]).drop("feature")


def high_discrepancy(drift: DataFrame) -> DataFrame:
    """Features whose mean moved by more than the tolerance of their calibration category."""
    return calibration_tolerance(drift).where(F.col("mean_diff_pct") > F.col("tolerance") * 100)


def file_profile(df: DataFrame, file: str, label: str = "Label", n_columns: int | None = None) -> DataFrame:
    """Rows, columns, benign and attack counts and the attack types per file."""
    benign = F.upper(F.trim(c(label))) == "BENIGN"
    return df.groupBy(c(file).alias("file")).agg(
        F.count("*").alias("rows"), F.lit(n_columns or len(df.columns)).alias("cols"),
        F.count_if(benign).alias("benign"), F.count_if(~benign).alias("attacks"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~benign, F.trim(c(label)))))).alias("attack_types"))
