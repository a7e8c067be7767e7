"""Global order without a single task: row numbers, running sums, exact quantiles.

A window with no partition sends the whole table to one task, and a window over
a hot group does the same for that group. Here rows are first placed in ordered
buckets; sums per bucket are small, and the window runs inside one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.functions.hashing import hash_key
from pairlab.session import task_count

LEAST_HASH_DIGITS = 3  # 4,096 hash buckets; more with more tasks
MAX_VALUE_BUCKETS = 4096


def _offsets(df: DataFrame, group: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sum of all earlier buckets, per group and bucket (bounded rows per group)."""
    keys = [*group, "_bucket"]
    per_bucket = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    w = W.partitionBy(*(group or [F.lit(1)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return per_bucket.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums])


def _running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``sums`` inclusive of the current row; ``df`` carries an ordered ``_bucket``."""
    keys = [*group, "_bucket"]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = df.select("*", *[F.sum(c).over(w).alias(f"_i_{n}") for n, c in sums.items()])
    out = inner.join(_offsets(df, group, sums), keys)
    cols = [c for c in df.columns if c != "_bucket"]
    return out.select(*cols, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def running_by_hash(
    df: DataFrame, seed, key_cols: Sequence[str], value: Column | str, out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Running sum of ``value`` in the order of ``md5(seed|keys)``, current row included.

    ``key_cols`` must be unique inside a group. Hash prefixes spread even a hot
    group over thousands of buckets.
    """
    hk = hash_key(seed, *[F.col(c) for c in key_cols])
    # a few buckets for each task of the cluster, so a bucket does not grow with the table
    digits = max(LEAST_HASH_DIGITS, math.ceil(math.log(4 * task_count(df.sparkSession), 16)))
    keyed = df.withColumn("_hk", hk).withColumn("_bucket", F.substring("_hk", 1, digits))
    total = F.col(value) if isinstance(value, str) else value
    return _running(keyed, list(group), ["_hk", *key_cols], {out: total}).select(*df.columns, out)


def number_by_hash(
    df: DataFrame, seed, key_cols: Sequence[str], group: Sequence[str] = (), out: str = "idx"
) -> DataFrame:
    """1-based position in hash order inside each group."""
    return running_by_hash(df, seed, key_cols, F.lit(1), out, group)


def running_by_value(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    group: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running sums in the order of a numeric column.

    The column must be distinct inside a group, or ``ties`` must order its equals.
    Bucket bounds are approximate percentiles of the whole column, ``buckets``
    numbers that pass through the driver: no bucket holds much more than that share
    of all rows, whatever the groups are. The result is exact for any bounds. The
    bounds are a job of their own, so materialise an expensive input first.
    ``buckets`` must be a power of two.
    """
    cols = df.columns
    if buckets is None:  # a power of two, about twice the tasks of a shuffle
        buckets = min(MAX_VALUE_BUCKETS, max(16, 1 << (2 * task_count(df.sparkSession) - 1).bit_length()))
    x = F.col(order).cast("double")
    df = df.withColumn("_x", -x if descending else x)
    sketch = F.percentile_approx("_x", [i / buckets for i in range(1, buckets)], 10 * buckets)
    bounds = df.agg(sketch.alias("b")).first()["b"] or []
    placed = df.withColumn("_bounds", F.lit(bounds).cast("array<double>"))
    # number of bounds below x by bisection, inside generated code
    placed = placed.withColumn("_bucket", F.lit(0))
    step = buckets // 2
    while step:
        hit = F.coalesce(F.get("_bounds", F.col("_bucket") + step - 1) < F.col("_x"), F.lit(False))
        placed = placed.withColumn("_bucket", F.col("_bucket") + F.when(hit, step).otherwise(0))
        step //= 2
    placed = placed.drop("_bounds")
    return _running(placed, list(group), ["_x", *ties], sums).select(*cols, *sums)


def take_first(
    df: DataFrame, order: Column, span: Column, n: Column, group: Sequence[str] = (), ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` rows of each group with the smallest integer ``order`` in [0, ``span``)."""
    # at most the number of buckets that running_by_value takes
    bucket = F.floor(order.cast("double") * MAX_VALUE_BUCKETS / F.greatest(span, F.lit(1)))
    placed = df.withColumns({"_ord": order, "_bucket": bucket, "_n": n})
    ranked = _running(placed, list(group), ["_ord", *ties], {"_pos": F.lit(1)})
    return ranked.filter(F.col("_pos") <= F.col("_n")).select(*df.columns)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles, one column per name in ``probs``.

    Counts per distinct value are pre-aggregated, then located by running counts,
    so a group of any size never has to fit into one task.
    """
    keys = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cum = running_by_value(counts, "_v", {"_cum": F.col("_n")}, keys)
    if keys:
        joined = cum.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    else:
        joined = cum.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    aggs = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        for tag, pos in (("lo", lo), ("hi", hi)):
            hit = (F.col("_cum") - F.col("_n") <= pos) & (pos < F.col("_cum"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(h - lo).alias(f"_f_{name}"))
    res = joined.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs
    ]
    return res.select(*group, *cols)
