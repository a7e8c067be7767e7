"""Names to ids, enrichment joins, family maps, score look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import base_name, missing_to_null
from pairlab.operators.rows import canonical_pair, first_per_key


def name_to_id(entities: DataFrame, name: str, id_col: str, order: str, mode: str = "first") -> DataFrame:
    """(name, id): the first or last row of a name wins; missing names are skipped."""
    if mode not in ("first", "last"):
        raise ValueError(f"unknown mode {mode!r}")
    named = entities.select(missing_to_null(name).alias("name"), F.col(id_col).alias("id"), F.col(order).alias("_ord"))
    return first_per_key(named.filter(F.col("name").isNotNull()), ["name"], ["_ord"], mode == "last").select("name", "id")


def name_map_report(entities: DataFrame, name: str) -> DataFrame:
    """One row: mapped names and skipped duplicates."""
    per_name = entities.select(missing_to_null(name).alias("n")).filter("n is not null").groupBy("n").count()
    return per_name.agg(
        F.count("*").alias("n_names"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates")
    )


def map_pairs(pairs: DataFrame, a: str, b: str, names: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Attach ``id_1`` and ``id_2``; without ``keep_missing`` both must be known."""
    how = "left" if keep_missing else "inner"
    left = names.select(F.col("name").alias(a), F.col("id").alias("id_1"))
    right = names.select(F.col("name").alias(b), F.col("id").alias("id_2"))
    return pairs.join(left, a, how).join(right, b, how).select(*pairs.columns, "id_1", "id_2")


def map_report(pairs: DataFrame, a: str, b: str, names: DataFrame) -> DataFrame:
    m = map_pairs(pairs, a, b, names, keep_missing=True)
    ok = F.col("id_1").isNotNull() & F.col("id_2").isNotNull()
    return m.agg(F.count_if(ok).alias("n_mapped"), F.count_if(~ok).alias("n_missing"))


def resolve_exact_then_base(queries: DataFrame, name: str, keys: DataFrame, key: str, order: str) -> DataFrame:
    """Exact key, or else the first key whose base name equals the wanted name."""
    exact = keys.select(F.col(key).alias(name), F.col(key).alias("_exact")).distinct()
    by_base = (
        keys.groupBy(base_name(key).alias(name)).agg(F.min_by(key, order).alias("_base"))
    )
    return (
        queries.join(exact, name, "left").join(by_base, name, "left")
        .select(*queries.columns, F.coalesce("_exact", "_base").alias("resolved"))
    )


def first_match_enrich(
    left: DataFrame, right: DataFrame, key: str, order: str, columns: Sequence[str], default: str = ""
) -> DataFrame:
    """Left join on ``key`` with the first right row by ``order``; no match gives the default."""
    first = first_per_key(right.select(key, order, *columns), [key], [order]).drop(order)
    joined = left.join(first, key, "left")
    return joined.select(*left.columns, *[F.coalesce(c, F.lit(default)).alias(c) for c in columns])


def isoform_representative(entities: DataFrame, name: str) -> DataFrame:
    """(base, official_name): first full name in sorted order per base name."""
    return entities.filter(F.col(name).isNotNull()).groupBy(base_name(name).alias("base")).agg(
        F.min(name).alias("official_name")
    )


def resolve_gold(raw: DataFrame, a: str, b: str, reps: DataFrame) -> DataFrame:
    """Both sides through the representative; originals kept, unresolved pairs dropped."""
    r1 = reps.select(F.col("base").alias(a), F.col("official_name").alias("resolved_1"))
    r2 = reps.select(F.col("base").alias(b), F.col("official_name").alias("resolved_2"))
    return raw.join(r1, a).join(r2, b).select(*raw.columns, "resolved_1", "resolved_2")


def family_map(
    pairs: DataFrame, a: str, b: str, family_1: str, family_2: str, order: str, own_side: bool = False
) -> DataFrame:
    """(entity, family), first mention wins.

    Default: the pair's family (first side, else second) counts for both ends.
    ``own_side``: each end takes its own side's family.
    """
    f1, f2 = F.nullif(F.trim(family_1), F.lit("")), F.nullif(F.trim(family_2), F.lit(""))
    one = (f1, f2) if own_side else (F.coalesce(f1, f2), F.coalesce(f1, f2))
    ends = F.array(
        F.struct(F.col(a).alias("entity"), one[0].alias("family"), F.lit(0).alias("side")),
        F.struct(F.col(b).alias("entity"), one[1].alias("family"), F.lit(1).alias("side")),
    )
    flat = pairs.select(F.col(order).alias("_ord"), F.explode(ends).alias("e")).select("_ord", "e.*")
    return flat.filter(F.col("family").isNotNull()).groupBy("entity").agg(
        F.min_by("family", F.struct("_ord", "side")).alias("family")
    )


def score_lookup(
    pairs: DataFrame, a: str, b: str, scores: DataFrame, columns: Sequence[str], default: float | None = None
) -> DataFrame:
    """Attach canonical (id_a < id_b) pair scores to pairs in either order.

    ``default`` fills pairs without a score; None drops them.
    """
    keyed = canonical_pair(pairs, a, b, "_lo", "_hi")
    s = scores.select(F.col("id_a").alias("_lo"), F.col("id_b").alias("_hi"), *columns)
    joined = keyed.join(s, ["_lo", "_hi"], "inner" if default is None else "left")
    values = [F.col(c) if default is None else F.coalesce(c, F.lit(float(default))).alias(c) for c in columns]
    return joined.select(*pairs.columns, *values)


def symmetrize_scores(scores: DataFrame, columns: Sequence[str], self_values: DataFrame | None = None) -> DataFrame:
    """Both orders of every canonical pair, plus optional (id_a, id_b, ...) self rows."""
    flip = F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))))
    both = scores.filter(F.col("id_a") != F.col("id_b")).select(flip.alias("p"), *columns).select("p.*", *columns)
    return both.unionByName(self_values) if self_values is not None else both


def run_consistency(
    run_a: DataFrame, run_b: DataFrame, keys: Sequence[str], metrics: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """One row: sizes of both runs, matched rows, and whether all metrics agree.

    ``consistent`` is NULL when the sizes differ (nothing is compared then).
    """
    a = run_a.select(*keys, *[F.col(m).alias(f"_a_{m}") for m in metrics], F.lit(True).alias("_in_a"))
    b = run_b.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics], F.lit(True).alias("_in_b"))
    close = reduce(
        lambda x, y: x & y,
        [F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}")) <= atol + rtol * F.abs(F.col(f"_b_{m}")) for m in metrics],
    )
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    res = a.join(b, list(keys), "full_outer").agg(
        F.count("_in_a").alias("n_a"),
        F.count("_in_b").alias("n_b"),
        F.count_if(both).alias("n_matched"),
        F.bool_and(F.coalesce(close, F.lit(False))).alias("_all"),
    )
    return res.select("n_a", "n_b", "n_matched", F.when(F.col("n_a") == F.col("n_b"), F.col("_all")).alias("consistent"))


def merge_folds(left: DataFrame, right: DataFrame, on: str = "fold") -> DataFrame:
    return left.join(right, on)
