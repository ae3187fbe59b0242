"""Small score expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    """x brought into [0, 1]; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def severity(score: Column) -> Column:
    return F.when(score > 0.7, "CRITICAL").when(score > 0.55, "HIGH").otherwise("MEDIUM")


def items_key(items: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(items), separator)


def render_sequence(sequence: Column) -> Column:
    return F.array_join(F.flatten(sequence), "→")


def label(col: Column) -> Column:
    return F.upper(F.trim(col))


def hash_sample(col: Column, share: float) -> Column:
    """A sample that does not change with partitioning; off where share is 1."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(col), F.lit(1_000_000)) < int(share * 1_000_000)
