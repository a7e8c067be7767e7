"""Scans: Parquet tables, dirty CSV catalogues, vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.text import NBSP


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_header(name: str) -> str:
    return name.replace(NBSP, " ").strip()


def read_dirty_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV catalogue; non-breaking and outer spaces are stripped from the header names.

    Without ``schema`` every column is read as text, so the file is scanned once.
    ``multi_line`` allows line breaks inside quoted fields; a file then is one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[clean_header(c) for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available columns: {df.columns}")
    return df


def read_vectors(
    spark: SparkSession, path: str, id_col: str, vector_col: str, metadata: Sequence[str] = ()
) -> DataFrame:
    """Id, metadata and vector (as doubles). Only these columns reach the scan."""
    df = require_columns(spark.read.parquet(path), [id_col, vector_col, *metadata])
    return df.select(
        F.col(id_col).alias("id"),
        *[F.col(c) for c in metadata],
        F.col(vector_col).cast("array<double>").alias("v"),
    )
