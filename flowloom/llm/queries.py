"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, grace_dedup, lattice_dedup, lexical_search, license_scan, media_archive, minhash_dedup, mixing, packing,
    periodic_runs, quality_lm, substring_dedup, toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_chat_format", chat_format.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"]))


@query("op3_license_scan", license_scan.sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@query("op4_media_archive")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_archive.digests(media_archive.stored(table(spark, sf_dir, "documents")))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(table(spark, sf_dir, "documents"))
    return placed.withColumns({"length": placed["length"].cast("long"), "offset": placed["offset"].cast("long")})


@query("op6_quality_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_lattice_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.linked(table(spark, sf_dir, "embeddings"))


@query("op8_minhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_offending", F.size("spans")).withColumn("first_offending", F.try_element_at("spans", F.lit(1))["start"]).drop("spans")


@query("op11_grace_dedup", grace_dedup.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted))


@query("op13_lexical_search", lexical_search.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.indexed(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
