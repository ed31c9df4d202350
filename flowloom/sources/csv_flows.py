"""Labelled flow CSV files, and the parquet data sets derived from them."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FEATURES
from ..functions.bounded import pin_small
from ..functions.columns import c
from ..operators.clean import union_files
from .files import located


def clean_header(line: str) -> list[str]:
    """Column names of a header line: trimmed, and a repeated name gets `.1`, `.2`, ..."""
    seen: dict[str, int] = {}
    out = []
    for raw in line.rstrip("\r\n").lstrip("﻿").split(","):
        name = raw.strip().strip('"')
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}.{n}")
    return out


def _first_lines(batches):
    for files in batches:
        lines = []
        for uri in files["file"]:
            fs, path = located(uri)
            with fs.open_input_stream(path) as stream:
                text = b""
                while b"\n" not in text and (more := stream.read(65536)):
                    text += more
            lines.append(text.split(b"\n", 1)[0].decode("utf-8", "replace"))
        yield pd.DataFrame({"file": files["file"], "header": lines})


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """`(file, header)` for every CSV file of a folder; opens each file only for its first line."""
    files = sorted(spark.read.option("pathGlobFilter", "*.csv").text(path).inputFiles())
    if not files:
        raise FileNotFoundError(f"no CSV files under {path}")
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 256))
    return listed.mapInPandas(_first_lines, "file string, header string")


def header_cells(headers: DataFrame) -> DataFrame:
    """`(file, position, name)` rows as the column contract wants them."""
    return headers.select("file", F.posexplode(F.split("header", ",")).alias("position", "name"))


def flow_schema(names: list[str]) -> T.StructType:
    known = set(FEATURES)
    return T.StructType([T.StructField(n, T.DoubleType() if n in known else T.StringType()) for n in names])


def read_flow_csvs(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """All CSV files of a folder as one table with clean names, plus `source_file`.

    The schema comes from the header line and not from inference: positions decide,
    so repeated headers and stray spaces do no harm. Files with the same header are
    read together; columns missing from some files become NULL there.
    """
    _, rows = pin_small(read_headers(spark, path))
    if rows is None:
        raise ValueError("too many files for one read; pass sub-folders")
    by_header: dict[str, list[str]] = {}
    for r in sorted(rows):
        by_header.setdefault(r.header, []).append(r.file)
    tables = []
    for header, files in by_header.items():
        frame = (
            spark.read.schema(flow_schema(expected or clean_header(header)))
            .options(header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
            .csv([unquote(f) for f in files])  # listed names are percent-encoded
        )
        tables.append(frame.select("*", F.col("_metadata.file_name").alias("source_file")))
    return union_files(tables)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One parquet data set; a split is a partition, so reading one skips the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_model_ready(df: DataFrame, features: list[str], path: str, target: str = "Label_Binary") -> None:
    write_splits(df.select(*[c(n) for n in features], c(target).alias("target"), "split"), path)
