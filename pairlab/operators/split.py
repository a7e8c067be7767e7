"""Leakage-safe splits: whole components, never single pairs, change sides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.graph import component_sizes
from pairlab.operators.order import number_by_hash, running_by_hash


def split_train_test(components: DataFrame, seed: int = 42, fraction: float = 0.2) -> DataFrame:
    """(id, component, split).

    Components with pairs go to test, in hash order, until at least
    round(fraction * covered ids) ids are there (the last one may overshoot).
    Ids without pairs are split on their own: round(fraction * n) to test.
    """
    sizes = component_sizes(components)
    multi = sizes.filter("size > 1")
    target = multi.agg(F.bround(F.coalesce(F.sum("size"), F.lit(0)) * fraction).alias("t")).scalar()
    run = running_by_hash(multi, f"{seed}|component", ["component"], "size", "_run")
    placed = run.select(
        "component", F.when(F.col("_run") - F.col("size") < target, "test").otherwise("train").alias("split")
    )
    single = sizes.filter("size = 1")
    n_test = single.agg(F.bround(F.count("*") * fraction).alias("n")).scalar()
    free = number_by_hash(single, f"{seed}|free", ["component"]).select(
        "component", F.when(F.col("idx") <= n_test, "test").otherwise("train").alias("split")
    )
    return components.join(placed.unionByName(free), "component").select("id", "component", "split")


def _quotas(sizes: list[tuple[int, int]], targets: Sequence[float]) -> list[tuple[int, int, int, int]]:
    """Largest-first packing into the largest deficit: (size, bin, first, last).

    Items of one size are interchangeable, so the packing only needs how many of
    them each bin takes. Taking the largest deficit ``count`` times is the same as
    taking the ``count`` largest values of ``target - filled - size * j``; a
    bisected level finds all but a few of them at once.
    """
    filled = [0] * len(targets)
    out = []
    bins = range(len(targets))
    for size, count in sorted(sizes, reverse=True):
        taken = [0] * len(targets)

        def above(level: float) -> list[int]:
            return [max(0, math.ceil((targets[k] - filled[k] - level) / size)) for k in bins]

        hi = max(targets[k] - filled[k] for k in bins)
        lo = hi - size * (count + 1)
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(above(mid)) <= count - len(targets) else (mid, hi)
        if count > len(targets) and sum(above(hi)) <= count:
            taken = above(hi)
        while sum(taken) < count:
            k = max(bins, key=lambda i: targets[i] - (filled[i] + size * taken[i]))
            taken[k] += 1
        start = 1
        for k in bins:
            if taken[k]:
                out.append((size, k, start, start + taken[k] - 1))
                start += taken[k]
            filled[k] += size * taken[k]
    return out


def _pack(groups: DataFrame, fractions: Sequence[float], seed: str) -> DataFrame:
    """(component, size) to (component, bin).

    Only the (size, count) histogram reaches the driver. Sizes are distinct and
    add up to at most N, so it has fewer than sqrt(2 N) rows.
    """
    spark = groups.sparkSession
    hist = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    total = sum(s * n for s, n in hist)
    quotas = _quotas(hist, [f * total for f in fractions])
    table = spark.createDataFrame(quotas, "size long, bin int, first long, last long")
    numbered = number_by_hash(groups, seed, ["component"], ["size"])
    return numbered.join(
        table, (numbered["size"] == table["size"]) & F.col("idx").between(F.col("first"), F.col("last"))
    ).select("component", "bin")


def split_three_way(
    components: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """(id, component, split): components with pairs are packed first, free ids separately."""
    sizes = component_sizes(components)
    fractions = [train, val, 1 - train - val]
    multi = _pack(sizes.filter("size > 1"), fractions, f"{seed}|pack")
    single = _pack(sizes.filter("size = 1"), fractions, f"{seed}|single")
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    placed = multi.unionByName(single).select("component", F.get(names, F.col("bin")).alias("split"))
    return components.join(placed, "component").select("id", "component", "split")


def starved_splits(splits: DataFrame) -> DataFrame:
    """Splits that received no component with pairs (a warning table, empty when fine)."""
    sizes = splits.groupBy("split", "component").agg(F.count("*").alias("size"))
    per = sizes.groupBy("split").agg(F.count_if(F.col("size") > 1).alias("n_informative"))
    wanted = splits.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return wanted.join(per, "split", "left").filter(F.coalesce("n_informative", F.lit(0)) == 0).select("split")


def split_kfold(components: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, component, fold): equal greedy bins; free ids are dealt round-robin."""
    sizes = component_sizes(components)
    multi = _pack(sizes.filter("size > 1"), [1 / k] * k, f"{seed}|fold").withColumnRenamed("bin", "fold")
    free = number_by_hash(sizes.filter("size = 1"), f"{seed}|deal", ["component"])
    dealt = free.select("component", ((F.col("idx") - 1) % k).cast("int").alias("fold"))
    return components.join(multi.unionByName(dealt), "component").select("id", "component", "fold")


def split_loco(components: DataFrame) -> DataFrame:
    """(id, component, fold): one fold per component with pairs; free ids have fold NULL (always train)."""
    sizes = component_sizes(components)
    fold = F.when(F.col("size") > 1, F.col("component"))
    return components.join(sizes, "component").select("id", "component", fold.alias("fold"))


def assign_pair_split(
    pairs: DataFrame, a: str, b: str, splits: DataFrame, split_col: str = "split"
) -> DataFrame:
    """Attach both ends' split; ``split`` is NULL where they differ."""
    s1 = splits.select(F.col("id").alias(a), F.col(split_col).alias("split_1"))
    s2 = splits.select(F.col("id").alias(b), F.col(split_col).alias("split_2"))
    joined = pairs.join(s1, a).join(s2, b)
    return joined.select(
        *pairs.columns, "split_1", "split_2", F.when(F.col("split_1") == F.col("split_2"), F.col("split_1")).alias("split")
    )


def leak_report(pairs: DataFrame, a: str, b: str, splits: DataFrame, entities: DataFrame) -> DataFrame:
    """One row; all but ``n_ids`` must be 0."""
    per_id = splits.groupBy("id").agg(F.count("*").alias("n"))
    ids = entities.select("id").join(per_id, "id", "left").agg(
        F.count("*").alias("n_ids"),
        F.count_if(F.col("n").isNull()).alias("n_uncovered"),
        F.count_if(F.col("n") > 1).alias("n_overlapping"),
    )
    cross = assign_pair_split(pairs, a, b, splits).agg(F.count_if(F.col("split").isNull()).alias("n_crossing"))
    return ids.withColumn("n_crossing", cross.scalar())


def leak_check(pairs: DataFrame, a: str, b: str, splits: DataFrame, entities: DataFrame) -> None:
    """Raise when a split is not disjoint and covering, or a pair crosses it."""
    r = leak_report(pairs, a, b, splits, entities).first()
    if r["n_uncovered"] or r["n_overlapping"] or r["n_crossing"]:
        raise ValueError(f"leaking split: {r.asDict()}")


def cross_split_drop(pairs: DataFrame, a: str, b: str, splits: DataFrame) -> DataFrame:
    """Keep documented negatives whose ends share a split."""
    both = assign_pair_split(pairs, a, b, splits)
    return both.filter(F.col("split").isNotNull()).select(*pairs.columns, "split")


def fit_val_pairs(pairs: DataFrame, keys: Sequence[str], seed: int = 42, fraction: float = 0.15) -> DataFrame:
    """``part`` is val for round(fraction * n) pairs, else fit."""
    n_val = pairs.agg(F.bround(F.count("*") * fraction).alias("n")).scalar()
    numbered = number_by_hash(pairs, f"{seed}|val", keys)
    return numbered.withColumn("part", F.when(F.col("idx") <= n_val, "val").otherwise("fit")).drop("idx")


def fit_val_stratified(
    rows: DataFrame, keys: Sequence[str], label: str = "label", seed: int = 42, fraction: float = 0.15
) -> DataFrame:
    """The same per label."""
    n_val = rows.groupBy(label).agg(F.bround(F.count("*") * fraction).alias("_nv"))
    numbered = number_by_hash(rows, f"{seed}|val", keys, [label]).join(n_val, label)
    part = F.when(F.col("idx") <= F.col("_nv"), "val").otherwise("fit").alias("part")
    return numbered.select(*rows.columns, part)


