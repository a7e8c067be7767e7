"""The labelled pair dataset: positives, documented and mined negatives per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.evidence import exclude_by_prefix, with_evidence_weight
from pairlab.operators.graph import connected_components
from pairlab.operators.resolve import family_map
from pairlab.operators.rows import canonical_pair, dedup_unordered_pair, known_endpoints, union_labelled
from pairlab.operators.sampling import DATASET_RATIO, HARD_FRACTION, documented_need, neg_mixed
from pairlab.operators.split import cross_split_drop, split_three_way
from pairlab.session import truncate_lineage

COLUMNS = ["id_1", "id_2", "label", "weight", "pair_type", "evidence_level", "split"]


def positive_pairs(gold: DataFrame, entities: DataFrame) -> DataFrame:
    """Usable positives: not excluded, both ends known, one row per unordered pair, weighted."""
    kept = known_endpoints(exclude_by_prefix(gold), entities, "id", "id_1", "id_2")
    return with_evidence_weight(dedup_unordered_pair(kept, "id_1", "id_2", ["pair_id"]))


def build_pair_dataset(
    vectors: DataFrame,
    gold: DataFrame,
    documented: DataFrame | None = None,
    seed: int = 42,
    ratio: float = DATASET_RATIO,
    hard_fraction: float = HARD_FRACTION,
) -> DataFrame:
    """Labelled pairs of all splits in one plan; ``split`` is a column to partition by.

    Components are packed whole, so no pair crosses a split; negatives come from
    the split's own entities and never are a known positive of any split.
    """
    positives = positive_pairs(gold, vectors)
    components = connected_components(positives, "id_1", "id_2", vectors)
    splits = truncate_lineage(split_three_way(components, seed=seed))
    pos = cross_split_drop(positives, "id_1", "id_2", splits)
    families = family_map(positives, "id_1", "id_2", "family_1", "family_2", "pair_id")
    pool = splits.select("id", "split").join(families.withColumnRenamed("entity", "id"), "id", "left")
    known = canonical_pair(positives, "id_1", "id_2").select("id_a", "id_b")
    pos_rows = pos.select(
        "id_1", "id_2", F.lit(1).alias("label"), F.round("weight", 3).alias("weight"), F.lit("positive").alias("pair_type"),
        F.coalesce("evidence_level", F.lit("")).alias("evidence_level"), "split",
    )
    parts = [pos_rows]
    if documented is not None:
        listed = known_endpoints(documented, vectors, "id", "id_1", "id_2")
        doc = cross_split_drop(listed, "id_1", "id_2", splits)
        parts.append(
            doc.select(
                "id_1", "id_2", F.lit(0).alias("label"), F.lit(1.0).alias("weight"), F.lit("negative_documented").alias("pair_type"),
                F.col("finding_type").alias("evidence_level"), "split",
            )
        )
        wanted = documented_need(pos, doc, "split", ratio)
    else:
        wanted = documented_need(pos, pos.limit(0), "split", ratio)
    mined = neg_mixed(pool, known, wanted, vectors.select("id", "v"), seed, "split", hard_fraction)
    parts.append(
        mined.select(
            F.col("id_a").alias("id_1"), F.col("id_b").alias("id_2"), F.lit(0).alias("label"), F.lit(1.0).alias("weight"),
            "pair_type", F.lit("").alias("evidence_level"), F.col("grp").alias("split"),
        )
    )
    return union_labelled(*parts).select(*COLUMNS)
