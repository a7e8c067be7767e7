"""Shared test helpers."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import SparkSession


def make_session(shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("pairlab-tests")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def norm(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return f"{round(float(x), 6):.6f}".replace("-0.000000", "0.000000")
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str([norm(y) for y in x])
        return str(x)

    def column(c):
        s = df[c]
        if str(s.dtype).startswith("float") and s.isna().any() and (s.dropna() % 1 == 0).all():
            return ["null" if pd.isna(v) else str(int(v)) for v in s]
        return [norm(v) for v in s]

    return sorted(zip(*[column(c) for c in cols])) if len(df) else []


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal as sets of rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    bad = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k and not (set(k) <= {"f", "i"} and got[c].isna().any())}
    if bad:
        return f"kinds {bad}"
    g, w = _rows(got), _rows(want)
    wrong = [(a, b) for a, b in zip(g, w) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}"[:500] if wrong else None
