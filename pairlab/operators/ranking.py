"""Directed queries, ranks from score tables, rank metrics and fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.order import running_by_value

TOP_K = (1, 5, 10, 20)  # fixed values: cut-offs of the reports
RRF_OFFSET = 60  # fixed value: constant of reciprocal-rank fusion


def bidirectional_queries(pairs: DataFrame, keep: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Each pair gives two directed queries; families swap with the direction."""
    has_family = "family_1" in pairs.columns

    def side(q: str, t: str) -> Column:
        cols = [F.col(f"id_{q}").alias("query_id"), F.col(f"id_{t}").alias("target_id"), F.lit(int(q)).alias("direction")]
        if has_family:
            cols += [F.col(f"family_{q}").alias("query_family"), F.col(f"family_{t}").alias("target_family")]
        return F.struct(*cols)

    flat = pairs.filter("id_1 <> id_2").select(*keep, F.explode(F.array(side("1", "2"), side("2", "1"))).alias("q"))
    return flat.select(*keep, "q.*")


def directed_examples(pairs: DataFrame) -> DataFrame:
    """(pair_id, input_id, target_id) in both directions."""
    q = bidirectional_queries(pairs)
    return q.select("pair_id", F.col("query_id").alias("input_id"), "target_id")


def hit_flags(ranked: DataFrame, top_k: Sequence[int] = TOP_K, rank: str = "rank") -> DataFrame:
    """Add the reciprocal rank and the 0/1 hit flags."""
    flags = [(F.col(rank) <= k).cast("int").alias(f"hits_at_{k}") for k in top_k]
    return ranked.select("*", (1.0 / F.col(rank)).alias("reciprocal_rank"), *flags)


def hits_mrr(ranked: DataFrame, group: Sequence[str] = (), top_k: Sequence[int] = TOP_K, rank: str = "rank") -> DataFrame:
    """Queries, MRR, mean rank and Hits@K, per group if asked."""
    aggs = [
        F.count("*").alias("n_queries"),
        F.avg(1.0 / F.col(rank)).alias("mrr"),
        F.avg(rank).alias("mean_rank"),
        *[F.avg((F.col(rank) <= k).cast("int")).alias(f"hits_at_{k}") for k in top_k],
    ]
    return ranked.groupBy(*group).agg(*aggs) if group else ranked.agg(*aggs)


def rank_from_scores(
    scores: DataFrame, targets: DataFrame, group: Sequence[str] = ("query_id",), ties: str = "by_id", score: str = "score"
) -> DataFrame:
    """Rank of the target inside a table of candidate scores (group, id, score).

    Counts only: the target's score is joined to the candidates and the better
    ones are summed with pre-aggregation, so no candidate list is sorted.
    ``ties="by_id"`` puts equal candidates with a smaller id first,
    ``"optimistic"`` counts strictly better ones only. Targets: (group, target_id).
    """
    own = scores.join(targets.withColumnRenamed("target_id", "id"), [*group, "id"]).select(
        *group, F.col("id").alias("target_id"), F.col(score).alias("_t")
    )
    better = F.col(score) > F.col("_t")
    if ties == "by_id":
        better = better | ((F.col(score) == F.col("_t")) & (F.col("id") < F.col("target_id")))
    elif ties != "optimistic":
        raise ValueError(f"unknown tie rule {ties!r}")
    joined = scores.join(own, list(group))
    return joined.groupBy(*group, "target_id").agg(
        (F.count_if(better & (F.col("id") != F.col("target_id"))) + 1).alias("rank"), F.max("_t").alias("score")
    )


def minmax_average(scores: DataFrame, methods: Sequence[str], group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Average of the per-query min-max scaled method columns, as ``score``.

    Ranges come from a pre-aggregated group-by that is joined back. The target
    is a normal candidate; the query itself must not be in the table.
    """
    aggs = [f(m).alias(f"_{n}_{m}") for m in methods for n, f in (("lo", F.min), ("hi", F.max))]
    ranges = scores.groupBy(*group).agg(*aggs)
    scaled = [(F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}") + 1e-12) for m in methods]
    total = scaled[0]
    for s in scaled[1:]:
        total = total + s
    return scores.join(ranges, list(group)).select(*scores.columns, (total / len(methods)).alias("score"))


def method_ranks(scores: DataFrame, methods: Sequence[str], group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Add ``{method}_rank`` (1 = best, ties by id) for every candidate of a query.

    Bucketed running counts instead of one window per query: a query's whole
    candidate list never has to be sorted in one task.
    """
    out = scores
    for m in methods:
        out = running_by_value(out, m, {f"{m}_rank": F.lit(1)}, group, descending=True, ties=["id"])
    return out


def rrf(scores: DataFrame, methods: Sequence[str], group: Sequence[str] = ("query_id",), offset: int = RRF_OFFSET) -> DataFrame:
    """Reciprocal-rank fusion of the method columns, as ``score``."""
    ranked = method_ranks(scores, methods, group)
    total = F.lit(0.0)
    for m in methods:
        total = total + 1.0 / (F.lit(float(offset)) + F.col(f"{m}_rank"))
    return ranked.select(*scores.columns, total.alias("score"))


def two_method_ranks(scores: DataFrame, targets: DataFrame, methods: Sequence[str], group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rank of the same targets in the same pool by several score columns, one row per target."""
    own = scores.join(targets.withColumnRenamed("target_id", "id"), [*group, "id"]).select(
        *group, F.col("id").alias("target_id"), *[F.col(m).alias(f"_t_{m}") for m in methods]
    )
    joined = scores.join(own, list(group))

    def rank(m: str) -> Column:
        better = (F.col(m) > F.col(f"_t_{m}")) | ((F.col(m) == F.col(f"_t_{m}")) & (F.col("id") < F.col("target_id")))
        return (F.count_if(better & (F.col("id") != F.col("target_id"))) + 1).alias(f"{m}_rank")

    return joined.groupBy(*group, "target_id").agg(*[rank(m) for m in methods])


def best_method(metrics: DataFrame, baselines: Sequence[str] = (), by: str = "mrr") -> DataFrame:
    """Methods by descending metric, NaN and NULL last, with a "beats all baselines" flag."""
    clean = metrics.withColumn(by, F.nanvl(by, F.lit(None).cast("double")))
    out = clean
    if baselines:
        bar = clean.filter(F.col("method").isin(*baselines)).agg(F.max(by)).scalar()
        out = clean.withColumn("beats_baselines", F.coalesce(F.col(by) > bar, F.lit(False)))
    return out.orderBy(F.col(by).desc_nulls_last(), "method")
