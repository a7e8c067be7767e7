"""The end-to-end retrieval evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.ranking import TOP_K, bidirectional_queries, hits_mrr
from pairlab.operators.similarity import rank_targets


def ranked_queries(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", **options) -> DataFrame:
    """Every pair in both directions, with the rank of its partner among all entities."""
    known = vectors.select("id")
    q = bidirectional_queries(pairs)
    for side in ("query_id", "target_id"):
        q = q.join(known.withColumnRenamed("id", side), side, "left_semi")
    return rank_targets(q, vectors, metric, **options)


def evaluate(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", top_k: Sequence[int] = TOP_K, **options) -> DataFrame:
    """One row: queries, MRR, mean rank, Hits@K."""
    return hits_mrr(ranked_queries(pairs, vectors, metric, **options), top_k=top_k)


def weighted(vectors: DataFrame) -> DataFrame:
    """Vectors with coordinate i scaled by i: a second, different geometry of the same entities."""
    return vectors.withColumn("v", F.transform("v", lambda x, i: x * (i + 1)))
