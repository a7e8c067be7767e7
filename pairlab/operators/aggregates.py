"""Reports and group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.functions.evidence import evidence_bucket
from pairlab.operators.order import exact_quantiles


def dq_report(df: DataFrame, key: Sequence[str], missing: Sequence[str]) -> DataFrame:
    """Rows, duplicates on ``key`` and missing values per column of the kept rows.

    Pre-aggregated per key; a missing value is NULL or "". The first row of a key
    counts as kept, all rows of one key agree on the key columns.
    """
    flags = [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in missing]
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("_n"), *[F.bool_or(f).alias(f"_m_{c}") for c, f in zip(missing, flags)]
    )
    return per_key.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
        *[F.count_if(F.col(f"_m_{c}")).alias(f"n_missing_{c}") for c in missing],
    )


def length_stats(df: DataFrame, seq: str) -> DataFrame:
    n = F.length(seq)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("n_empty"),
        F.avg(n).alias("mean_length"),
        F.max(n).alias("max_length"),
        F.min(n).alias("min_length"),
    )


def describe(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles (linear), max."""
    stats = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    quart = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if group:
        basic = df.groupBy(*group).agg(*stats)
        return basic.join(exact_quantiles(df, value, quart, group), list(group), "left")
    row = exact_quantiles(df, value, quart).select(F.struct(*quart).alias("q")).scalar()
    return df.agg(*stats).withColumn("_q", row).select("n", "mean", "std", "min", "max", *[F.col("_q")[q].alias(q) for q in quart])


def bucket_share(pairs: DataFrame, level: str = "evidence_level") -> DataFrame:
    """Rows and share of each evidence bucket (at most four rows reach the window)."""
    counts = pairs.groupBy(evidence_bucket(level).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, label: str, bins: int = 20) -> DataFrame:
    """Equal-width bins per label over that label's range; the last bin is closed.

    The first shuffle is the pre-aggregated range per label, the second the
    pre-aggregated bin counts.
    """
    ranges = df.groupBy(label).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    pos = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    binned = df.join(ranges, label).withColumn("bin", pos.cast("int"))
    return binned.groupBy(label, "bin").agg(
        F.count("*").alias("n"),
        F.min(F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        F.min(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
    )


def trim_special_tokens(tokens: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Keep positions 1 .. n_valid - 2, renumbered from 0.

    ``lengths`` (id, n_valid) may come from metadata; else it is counted.
    """
    n = lengths if lengths is not None else tokens.groupBy("id").agg(F.count("*").alias("n_valid"))
    kept = tokens.join(n, "id").filter((F.col("pos") >= 1) & (F.col("pos") <= F.col("n_valid") - 2))
    return kept.withColumn("pos", F.col("pos") - 1).drop("n_valid")


def pool_tokens(tokens: DataFrame, how: str = "mean") -> DataFrame:
    """(id, v): element-wise mean or maximum over the tokens of an entity.

    The summarizer keeps one partial vector per entity and map task, so long
    entities neither shuffle their tokens nor meet in one task.
    """
    agg = {"mean": Summarizer.mean, "max": Summarizer.max}[how]
    pooled = tokens.groupBy("id").agg(agg(array_to_vector("v")).alias("_v"))
    return pooled.select("id", vector_to_array("_v").alias("v"))


def length_summary(tokens: DataFrame) -> DataFrame:
    """Tokens per entity: min, mean, max."""
    n = tokens.groupBy("id").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("n_entities"), F.min("n").alias("min_tokens"),
        F.avg("n").alias("mean_tokens"), F.max("n").alias("max_tokens"),
    )
