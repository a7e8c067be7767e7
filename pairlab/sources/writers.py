"""Sinks: Parquet / CSV tables, one folder per split."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists") -> None:
    """One folder per split, so a reader of one split prunes the others."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
