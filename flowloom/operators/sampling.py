"""Reproducible sampling, splitting and folding by hash order.

Rows of a class are ordered by `md5(seed | key)`, then by key. Every operator
here cuts that order at given ranks, so class counts are exact and a re-run
gives the same rows.

No class is ever sorted as a whole. Rows are counted per (class, leading hash
digits); from these counts follows, for each cut, the one hash bucket it falls
into. Rows of all other buckets are placed by comparing bucket numbers, and only
the rows of those few buckets are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import stabilise
from ..functions.columns import any_of, c

HASH_DIGITS = 4
MAX_CLASSES = 1_000


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c(key).cast("string")).cast("binary"))


def cut_by_rank(df: DataFrame, by: str | None, key: str, seed: int,
                cuts: Callable[[dict], dict], digits: int = HASH_DIGITS, part: str = "part") -> DataFrame:
    """Add `part`, the number of cuts at or below a row's 0-based rank in its class.

    `cuts` receives the rows per class and returns ascending ranks per class; rows
    of classes it leaves out are dropped. Classes are few (checked).
    """
    class_col = c(by) if by is not None else F.lit(0)
    hashed = df.withColumns({"_class": class_col, "_hash": hash_order(key, seed)}).withColumn(
        "_bucket", F.substring("_hash", 1, digits))
    counts = hashed.groupBy("_class", "_bucket").agg(F.count("*").alias("n"))
    per_bucket = stabilise(counts)  # a small table, used twice: one pass over the rows
    totals = {r["_class"]: r.n for r in per_bucket.groupBy("_class").agg(F.sum("n").alias("n"))
              .limit(MAX_CLASSES + 1).collect()}
    if len(totals) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {by!r}")
    wanted = cuts(totals)

    # The bucket each inner cut falls into, with the rows before that bucket.
    kind = hashed.schema["_class"].dataType.simpleString()
    spark = df.sparkSession
    inner = [(k, r) for k, ranks in wanted.items() for r in ranks if 0 < r < totals[k]]
    marks: dict = {k: [] for k in wanted}
    if inner:
        ranks = F.broadcast(spark.createDataFrame(inner, f"_class {kind}, rank long"))  # one row per class and cut
        upto = W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        cumulated = per_bucket.withColumn("after", F.sum("n").over(upto))
        hits = cumulated.join(ranks.withColumnRenamed("_class", "_of"), F.col("_class").eqNullSafe(F.col("_of"))).where(
            (F.col("rank") < F.col("after")) & (F.col("rank") >= F.col("after") - F.col("n")))
        for r in hits.collect():  # one row per class and cut
            marks[r["_class"]].append((r["_bucket"], r["rank"], r.after - r.n))

    # One row per class: how many cuts lie before its first row, then bucket, rank and base of each inner cut.
    width = max((len(m) for m in marks.values()), default=0)
    fields = [(f"_bucket{i}", f"_rank{i}", f"_base{i}") for i in range(width)]
    ddl = "".join(f", {b} string, {r} long, {n} long" for b, r, n in fields)
    per_class = F.broadcast(spark.createDataFrame([
        (k, sum(r <= 0 for r in ranks), *[x for m in _padded(sorted(marks[k]), width) for x in m])
        for k, ranks in wanted.items()], f"_class {kind}, _first int{ddl}"))

    def count_true(conditions: list[Column]) -> Column:
        return sum((F.coalesce(x.cast("int"), F.lit(0)) for x in conditions), F.col("_first"))

    rows = hashed.join(per_class.withColumnRenamed("_class", "_of"), F.col("_class").eqNullSafe(F.col("_of"))).drop("_of")
    helpers = ["_class", "_hash", "_bucket", "_first", "_rank", *[x for f in fields for x in f]]
    at_cut = F.coalesce(any_of([F.col("_bucket") == F.col(b) for b, _, _ in fields]), F.lit(False))
    easy = rows.where(~at_cut).withColumn(
        part, count_true([F.col("_bucket") > F.col(b) for b, _, _ in fields]))
    if not inner:
        return easy.drop(*helpers)
    w = W.partitionBy("_class", "_bucket").orderBy("_hash", c(key))
    base = F.coalesce(*[F.when(F.col("_bucket") == F.col(b), F.col(n)) for b, _, n in fields])
    cut = rows.where(at_cut).withColumn("_rank", base + F.row_number().over(w) - 1).withColumn(
        part, count_true([F.col("_rank") >= F.col(r) for _, r, _ in fields]))
    return easy.drop(*helpers).unionByName(cut.drop(*helpers))


def _padded(marks: list[tuple], width: int) -> list[tuple]:
    return marks + [(None, None, None)] * (width - len(marks))


def balance(df: DataFrame, key: str, ratio: float = 2.0, label: str = "Label_Binary", seed: int = 42) -> DataFrame:
    """Undersample the largest class to `int(smallest * ratio)` rows; other classes are dropped."""
    def cuts(totals: dict) -> dict:
        order = sorted(totals, key=lambda k: (totals[k], k is not None, k if k is not None else 0))
        smallest, largest = order[0], order[-1]
        keep = {largest: min(totals[largest], int(totals[smallest] * ratio))}
        keep[smallest] = totals[smallest]
        return {k: [n] for k, n in keep.items()}

    return cut_by_rank(df, label, key, seed, cuts).where("part = 0").drop("part")


def stratified_split(df: DataFrame, key: str, label: str = "Label_Binary", test: float = 0.15, val: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """Adds `split`: first `round(test * n)` rows of a class, then the validation share of the rest, then train."""
    def cuts(totals: dict) -> dict:
        out = {}
        for k, n in totals.items():
            n_test = int(test * n + 0.5)
            n_val = int(val / (1 - test) * (n - n_test) + 0.5)
            out[k] = [n_test, n_test + n_val]
        return out

    names = F.array(F.lit("test"), F.lit("val"), F.lit("train"))
    return cut_by_rank(df, label, key, seed, cuts).withColumn("split", F.get(names, F.col("part"))).drop("part")


def stratified_sample(df: DataFrame, key: str, n: int, label: str, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer: each class gives its share, the largest remainders round up, none is left out.

    With more classes than n, every class still gives one row.
    """
    def cuts(totals: dict) -> dict:
        total = sum(totals.values())
        give = {k: min(m, max(1, n * m // total)) for k, m in totals.items()}
        left = min(n, total) - sum(give.values())
        order = sorted(totals, key=lambda k: (-(n * totals[k] % total), k is not None, k if k is not None else 0))
        while left > 0:
            for k in [k for k in order if give[k] < totals[k]][:left]:
                give[k], left = give[k] + 1, left - 1
        while left < 0 and max(give.values()) > 1:
            for k in sorted(give, key=lambda k: -give[k])[:1]:
                give[k], left = give[k] - 1, left + 1
        return {k: [m] for k, m in give.items()}

    return cut_by_rank(df, label, key, seed, cuts).where("part = 0").drop("part")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return cut_by_rank(df, None, key, seed, lambda t: {k: [n] for k in t}).where("part = 0").drop("part")


def assign_folds(df: DataFrame, key: str, k: int, label: str, seed: int = 42) -> DataFrame:
    """Adds `fold`, 0 to k-1: equal consecutive shares of each class in hash order."""
    def cuts(totals: dict) -> dict:
        return {name: [-(-n * i // k) for i in range(1, k)] for name, n in totals.items()}

    return cut_by_rank(df, label, key, seed, cuts, part="fold")


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in an order set by their hashed content: mixed, yet the same when a task is repeated."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[c(n) for n in df.columns]))
