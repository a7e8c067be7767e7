"""Evidence levels: weights, buckets and the two exclusion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a positive pair by its exact evidence text.
EVIDENCE_WEIGHTS = {
    "Confirmed": 1.0,
    "Confirmed (with epitope-level caveat)": 0.9,
    "Confirmed (partial epitope overlap)": 0.85,
    "Confirmed but low real-world prevalence": 0.8,
    "Confirmed in this population (see NEG016 for a contradicting temperate-climate finding)": 0.7,
    "Strong evidence": 0.85,
    "Strong evidence (within-species paralogs)": 0.8,
    "Strong evidence (congeneric species)": 0.8,
    "Suspected (homology-based)": 0.6,
    "Suspected": 0.55,
    "Suspected (homology-based; reduced cross-subfamily reactivity)": 0.45,
    "Suspected (homology-based; reduced cross-reactivity)": 0.45,
    "Suspected (homology-based; reduced cross-reactivity reported)": 0.45,
    "Suspected (homology-based; low sequence identity)": 0.4,
    "Suspected (homology-based; weak/limited cross-reactivity)": 0.35,
    "Suspected (homology-based; moderate)": 0.5,
    "Suspected (homology-based; amphibian-fish)": 0.45,
    "Suspected (homology-based; within-species isoforms)": 0.55,
    "Suspected (homology-based only)": 0.5,
    "Suspected (homology-based; clinical significance under-researched)": 0.4,
    "Suspected (low confidence by design of source review)": 0.35,
    "Inferred (family-level homology)": 0.4,
}
DEFAULT_WEIGHT = 0.5

# The prefixes that mark a documented negative.
NEGATIVE_PREFIXES = (
    "Reported negative",
    "Reported NO cross-reactivity",
    "Reported low/weak",
    "Risky/Contested",
    "Suspected/Contested",
)
# Fixed value: the looser pattern used by the training and retrieval jobs.
NEGATIVE_REGEX = "negative|Contested|Risky|NO cross"

# Evidence buckets by prefix, and the weight of each bucket.
BUCKET_PREFIXES = {
    "Confirmed/Strong": ("Confirmed", "Strong"),
    "Suspected": ("Suspected",),
    "Inferred/family-level": ("Inferred",),
}
BUCKET_WEIGHTS = {"Confirmed/Strong": 1.00, "Suspected": 0.65, "Inferred/family-level": 0.45}
UNMAPPED = "UNMAPPED"
UNMAPPED_WEIGHT = 0.45


def with_evidence_weight(pairs: DataFrame, level: str = "evidence_level", out: str = "weight") -> DataFrame:
    """Attach the exact-match weight (default 0.5).

    The map is a constant of 22 entries, so it goes into the plan as a literal:
    no join and no shuffle.
    """
    entries = [F.lit(x) for item in EVIDENCE_WEIGHTS.items() for x in item]
    weight = F.try_element_at(F.create_map(*entries), F.coalesce(F.trim(level), F.lit("")))
    return pairs.withColumn(out, F.coalesce(weight, F.lit(DEFAULT_WEIGHT)))


def _starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda x, y: x | y, [c.startswith(p) for p in prefixes])


def evidence_bucket(level: Column | str) -> Column:
    text = F.trim(F.coalesce(F.col(level) if isinstance(level, str) else level, F.lit("")))
    names = list(BUCKET_PREFIXES)
    out = F.when(_starts_with_any(text, BUCKET_PREFIXES[names[0]]), names[0])
    for name in names[1:]:
        out = out.when(_starts_with_any(text, BUCKET_PREFIXES[name]), name)
    return out.otherwise(UNMAPPED)


def bucket_weight(bucket: Column | str) -> Column:
    c = F.col(bucket) if isinstance(bucket, str) else bucket
    out = None
    for name, w in BUCKET_WEIGHTS.items():
        out = F.when(c == name, w) if out is None else out.when(c == name, w)
    return out.otherwise(UNMAPPED_WEIGHT)


def exclude_by_regex(pairs: DataFrame, level: str = "evidence_level") -> DataFrame:
    """Drop rows whose evidence matches the loose pattern in any case; NULL is kept."""
    return pairs.filter(~F.coalesce(F.col(level).rlike("(?i)" + NEGATIVE_REGEX), F.lit(False)))


def exclude_by_prefix(pairs: DataFrame, level: str = "evidence_level") -> DataFrame:
    """Drop rows whose evidence starts with a documented-negative marker; NULL is kept."""
    text = F.trim(F.coalesce(F.col(level), F.lit("")))
    return pairs.filter(~_starts_with_any(text, NEGATIVE_PREFIXES))
