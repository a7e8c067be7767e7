"""Contiguous shards of nearly equal size from prefix sums.

Rows are range-partitioned once by the order columns and written as a checkpoint.
Each partition reports one total; the totals are summed up in partition order (as
many rows as partitions) and sent back, so every row knows how much lies before it.
Only the order columns and the size are moved; no window spans the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.session import truncate_lineage

RANGE_SALT = "_salt"


def prefix_sums(df: DataFrame, size: str, order: Sequence[str], before: str, position: str, total: str) -> DataFrame:
    """Adds the sum of ``size`` over all earlier rows, the number of earlier rows, and the whole sum.

    Order: ``order`` ascending, nulls first; equal rows follow each other in any order.
    ``size`` must be a non-null whole number. A random salt behind the order columns
    splits a key that many rows share over several range partitions.
    """
    cols = df.columns
    keys = [*order, RANGE_SALT]
    placed = (
        df.withColumn(RANGE_SALT, F.rand(7))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .drop(RANGE_SALT)
    )
    placed = truncate_lineage(placed)
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_s"), F.count("*").alias("_n"))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_o{c}") for c in ("_s", "_n")],
        F.sum("_s").over(W.partitionBy()).alias(total),
    )
    added = [T.StructField(c, T.LongType()) for c in (total, before, position)]
    schema = T.StructType([*[df.schema[c] for c in cols], *added])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = rows = 0
        for b in batches:
            n = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            run = np.cumsum(n)
            earlier = b.column("_o_s").to_numpy() + done + run - n
            place = b.column("_o_n").to_numpy() + rows + np.arange(len(n))
            done, rows = done + int(run[-1]), rows + len(n)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in cols], b.column(total), pa.array(earlier), pa.array(place)], [*cols, total, before, position]
            )

    # the joined table has one row per partition; a broadcast keeps the order of the other side
    return placed.join(F.broadcast(offsets), "_part").mapInArrow(add, schema)


def balanced_shards(df: DataFrame, size: str, order: Sequence[str], n_shards: int) -> DataFrame:
    """Adds ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... inside the shard).

    The line of all sizes is cut at equal targets; a row belongs to the shard in which
    its middle lies, so no shard is off its target by more than the largest row.
    With fewer rows than shards some shards stay empty. Null sizes and sizes below 1 count
    as 1 for the cut; null order values come first; an empty table gives an empty result.
    """
    cols = df.columns
    weighed = df.withColumn("_w", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)).cast("bigint"))
    lined = prefix_sums(weighed, "_w", order, "_before", "_position", "_total")
    middle = (2 * F.col("_before") + F.col("_w")).cast("decimal(25,0)") * F.lit(n_shards)
    cut = F.floor(middle / (2 * F.col("_total")).cast("decimal(25,0)")).cast("int")
    dealt = lined.withColumn("shard", F.least(cut, F.lit(n_shards - 1)))
    first = dealt.groupBy("shard").agg(F.min("_position").alias("_first"))  # one row per shard
    return dealt.join(F.broadcast(first), "shard").select(*cols, "shard", (F.col("_position") - F.col("_first")).alias("slot"))
