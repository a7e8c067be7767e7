"""Deterministic draws: every random number is a hash of its coordinates.

Results therefore do not depend on partitioning, task retries or the number of
executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


DRAW_DIGITS = 15  # hex digits: more positions than any pool has rows
DRAW_SPAN = 1 << 60


def _text(parts) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def hash_key(*parts) -> Column:
    """Hex order key of ``a|b|c``; plain values are literals, columns are columns."""
    return F.md5(_text(parts))


def hash_draw(*parts) -> Column:
    """60-bit integer draw of ``a|b|c``."""
    return F.conv(F.substring(hash_key(*parts), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def draw_index(size: Column, *parts) -> Column:
    """1-based index below ``size``."""
    return hash_draw(*parts) % size + 1
