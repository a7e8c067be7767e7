"""Scalar text functions of the catalogue-cleaning jobs (all JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
# The 20 standard residue letters.
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """NULL becomes "", non-breaking spaces become spaces, white space is trimmed."""
    spaced = F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(NBSP), F.lit(" "))
    return F.regexp_replace(spaced, r"^\s+|\s+$", "")


def strip_isoform(c: Column | str) -> Column:
    """Drop one trailing ``.digits``."""
    return F.regexp_replace(clean_text(c), r"\.[0-9]+$", "")


def base_name(c: Column | str) -> Column:
    """Text before the first dot."""
    return F.substring_index(clean_text(c), ".", 1)


def clean_sequence(c: Column | str) -> Column:
    """Keep ASCII letters, upper-case."""
    return F.upper(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z]", ""))


def valid_residues(c: Column | str) -> Column:
    """Keep only the 20 standard residue letters of the cleaned sequence."""
    return F.regexp_replace(clean_sequence(c), f"[^{STANDARD_RESIDUES}]", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def missing_to_null(c: Column | str) -> Column:
    """Empty text and the literal ``nan`` are both missing values."""
    text = clean_text(c)
    return F.when((text == "") | (F.lower(text) == "nan"), F.lit(None)).otherwise(text)


def make_id(entity: Column | str, isoform: Column | str) -> Column:
    """``WHO_{a}_ISO_{b}``, or ``WHO_{a}`` where there is no isoform id."""
    iso = clean_text(isoform)
    head = F.concat(F.lit("WHO_"), clean_text(entity))
    return F.when(iso != "", F.concat(head, F.lit("_ISO_"), iso)).otherwise(head)


def make_plain_id(entity: Column | str, isoform: Column | str) -> Column:
    """``{a}_{b}``, blanks kept."""
    return F.concat(clean_text(entity), F.lit("_"), clean_text(isoform))


def coalesce_name(preferred: Column | str, fallback: Column | str) -> Column:
    """Preferred name, or the fallback where the preferred one is empty."""
    return F.coalesce(blank_to_null(clean_text(preferred)), clean_text(fallback))


def join_nonempty(*parts: Column | str, sep: str = "; ") -> Column:
    return F.concat_ws(sep, *[blank_to_null(clean_text(p)) for p in parts])


def availability(sequence: Column | str) -> Column:
    return F.when(F.length(_col(sequence)) > 0, "Yes").otherwise("No")


def sequence_length(sequence: Column | str) -> Column:
    """Length, NULL where the sequence is missing or empty."""
    return F.nullif(F.length(_col(sequence)), F.lit(0))


def first_token(c: Column | str) -> Column:
    return F.split(clean_text(c), r"\s+")[0]


def food_keyword(c: Column | str) -> Column:
    """First word before any ``,`` or ``(``, lower-cased; "" for nothing."""
    head = F.substring_index(F.substring_index(F.coalesce(_col(c), F.lit("")), ",", 1), "(", 1)
    return F.lower(F.split(F.trim(head), r"\s+")[0])
