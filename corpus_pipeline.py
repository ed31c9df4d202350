"""The training-data pipeline: quality filter, near-dedup, substring dedup, mixing, packing.

Every stage takes `(spark, docs, sf_dir)` and works on what its predecessor kept. `run` writes each result to the
shared folder as Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.bounded import scratch, stabilise
from flowloom.llm import minhash_dedup, mixing, packing, quality_lm, substring_dedup
from flowloom.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language. All rows of a doc_id go if one is rejected; without one the text decides."""
    with scratch(spark) as keep:  # the rejected ids alone stay of what the operator stores
        scores = quality_lm.classified(docs.withColumn("doc_id", minhash_dedup.node_id()), table(spark, sf_dir, "labels"))
        rejected = keep(stabilise(scores.where(~F.col("keep")).select("doc_id").distinct()))
    return _without(docs, rejected)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word shingles of five, similarity 0.8. Rows without doc_id are documents by their text."""
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    docs = docs.where("doc_id is not null").unionByName(nameless)
    with scratch(spark) as keep:
        found = minhash_dedup.near_duplicates(docs.select(minhash_dedup.node_id().alias("doc_id"), "text"), width=5)
        rejected = keep(stabilise(found.where(~F.col("kept")).select("doc_id").distinct()))
    return _without(docs, rejected)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicated(docs).drop("removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each copy, in the order of `_shard` and `_order`."""
    return mixing.mixed(docs).select(*docs.columns, "_shard", "_order")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` without the rejected ids, as `node_id` names them. Texts stay where they are: the ids are bounded by a filter, the rest by a join."""
    named = docs.withColumn("_node", minhash_dedup.node_id())
    return minhash_dedup.without(named, rejected.withColumnRenamed("doc_id", "_node"), "_node").drop("_node")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring), ("mixing", mix), ("packing", pack)]
#: Tokenisation and the language model can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stabilise(stage(spark, docs, sf_dir))
    return docs
