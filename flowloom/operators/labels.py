"""Label encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import pin_small
from ..functions.columns import c


def binary_label(col: Column) -> Column:
    return F.when(F.upper(F.trim(col)) == "BENIGN", 0).otherwise(1)


def distinct_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.select(c(label).alias("label")).distinct().orderBy("label")


def label_mapping(df: DataFrame, label: str = "Label") -> DataFrame:
    """`(label, code)`: the rank of each raw label among the sorted distinct labels, from 0."""
    labels = df.select(c(label).alias("label")).distinct()
    return labels.select("label", (F.dense_rank().over(W.orderBy("label")) - 1).alias("code"))


def encode_labels(df: DataFrame, label: str = "Label") -> tuple[DataFrame, DataFrame]:
    """The table with the three encoded label columns, and the mapping."""
    mapping, _ = pin_small(label_mapping(df, label))
    encoded = df.join(
        mapping.select(F.col("label").alias("_label"), F.col("code").alias("Label_Multiclass")),
        c(label) == F.col("_label"), "left",
    ).drop("_label").withColumns({"Label_Original": c(label), "Label_Binary": binary_label(c(label))})
    return encoded, mapping


def class_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    counts = df.groupBy(c(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())).orderBy(
        F.desc("n"), "label")


def decode_labels(df: DataFrame, mapping: DataFrame, code: str = "prediction") -> DataFrame:
    """Adds `label` for a class code; a code outside the mapping reads `CLASS_<n>`."""
    small, _ = pin_small(mapping.select(F.col("code").alias("_code"), F.col("label").alias("_label")))
    return df.join(small, c(code) == F.col("_code"), "left").withColumn(
        "label", F.coalesce("_label", F.concat(F.lit("CLASS_"), c(code).cast("int").cast("string")))
    ).drop("_code", "_label")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight N / (classes * rows of the class) per class."""
    counts = df.groupBy(c(label).alias("label")).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))


def with_class_weight(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    small, _ = pin_small(class_weights(df, label).select(F.col("label").alias("_label"), F.col("weight").alias(weight)))
    return df.join(small, c(label) == F.col("_label")).drop("_label")
