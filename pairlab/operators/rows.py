"""Filters, duplicates, unions and sorts of entity and pair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import base_name


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, which must be unique.

    ``min_by`` pre-aggregates before the shuffle, so a key that holds a third of
    all rows costs one row per map task; a row_number window would sort them all
    in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )


def canonical_pair(df: DataFrame, a: str, b: str, out_a: str = "id_a", out_b: str = "id_b") -> DataFrame:
    """Add the unordered key (smaller id, larger id)."""
    return df.withColumns({out_a: F.least(a, b), out_b: F.greatest(a, b)})


def dedup_unordered_pair(df: DataFrame, a: str, b: str, order: Sequence[str]) -> DataFrame:
    keyed = canonical_pair(df, a, b, "_lo", "_hi")
    return first_per_key(keyed, ["_lo", "_hi"], order).select(*df.columns)


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def nonempty_sequence(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.filter(F.col(seq) != "")


def min_length(df: DataFrame, seq: str = "seq", minimum: int = 30, drop_empty: bool = False) -> DataFrame:
    """Drop short sequences; empty (or missing) ones stay unless ``drop_empty``."""
    n = F.length(F.coalesce(F.col(seq), F.lit("")))
    return df.filter(n >= minimum) if drop_empty else df.filter((n == 0) | (n >= minimum))


def count_short(df: DataFrame, seq: str = "seq", minimum: int = 30) -> Column:
    """Aggregate: how many rows ``min_length`` drops."""
    n = F.length(F.coalesce(F.col(seq), F.lit("")))
    return F.count_if((n > 0) & (n < minimum))


def has_key(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def missing_key(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def known_endpoints(pairs: DataFrame, entities: DataFrame, entity: str, a: str, b: str) -> DataFrame:
    """Pairs with both ends among the entities."""
    k = entities.select(entity)
    left = pairs.join(k.withColumnRenamed(entity, a), a, "left_semi")
    return left.join(k.withColumnRenamed(entity, b), b, "left_semi").select(*pairs.columns)


def drop_self_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b))


def union_endpoints(pairs: DataFrame, a: str, b: str, out: str = "entity") -> DataFrame:
    """Distinct names on either side, in one pass over the pairs."""
    return pairs.select(F.explode(F.array(a, b)).alias(out)).distinct()


def coverage_gap(pairs: DataFrame, a: str, b: str, catalogue: DataFrame, name: str) -> DataFrame:
    """Pair names without a catalogue entry of the same base name."""
    available = catalogue.select(base_name(name).alias("entity")).distinct()
    return union_endpoints(pairs, a, b).join(available, "entity", "left_anti")


def head_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First rows of a report."""
    return df.orderBy(*order).limit(n)


def sort_table(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order)


def union_labelled(*parts: DataFrame) -> DataFrame:
    """Union of labelled pair tables by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
