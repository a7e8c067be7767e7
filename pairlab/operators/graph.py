"""Connected components of the positive-pair graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import truncate_lineage


EDGES_PER_TASK = 200_000  # small graphs are kept in few partitions: every shuffle of a round writes files for each


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link every larger neighbour of u to the smallest id around u."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v")
    return moved.unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def _all_stars(edges: DataFrame) -> bool:
    """True when every edge runs from a centre to a leaf that has no other edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(0).alias("leaf")), F.struct(F.col("v").alias("n"), F.lit(1).alias("leaf")))).alias("e"))
    node = ends.select("e.*").groupBy("n").agg(F.sum("leaf").alias("as_leaf"), F.min("leaf").alias("only_leaf"))
    return node.filter("as_leaf > 1 or (as_leaf = 1 and only_leaf = 0)").isEmpty()


def connected_components(
    pairs: DataFrame, a: str, b: str, entities: DataFrame | None = None, entity: str = "id", max_rounds: int = 60
) -> DataFrame:
    """(id, component): the component is the smallest id in it.

    Alternating large-star / small-star rounds, logarithmic in practice. The hub
    of a giant component only ever meets its minimum (one pre-aggregated row), and
    the skewed join on it is split by AQE. Each round is reliably checkpointed; a
    round that leaves nothing but stars is the last. ``entities`` adds the
    entities without any pair as components of one.
    """
    edges = truncate_lineage(
        pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    )
    tasks = 1 + edges.count() // EDGES_PER_TASK  # no more than that; a larger number of partitions than there is stays
    edges = edges.coalesce(tasks)
    for _ in range(max_rounds):
        edges = truncate_lineage(_small_star(_large_star(edges, tasks), tasks))
        if _all_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    found = leaves.unionByName(roots)
    if entities is None:
        return found
    return entities.select(F.col(entity).alias("id")).join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def component_report(components: DataFrame) -> DataFrame:
    s = component_sizes(components)
    return s.agg(
        F.count("*").alias("n_components"),
        F.count_if(F.col("size") > 1).alias("n_multi"),
        F.count_if(F.col("size") == 1).alias("n_singletons"),
        F.max("size").alias("largest"),
    )
