"""Measures of two-sided results: who won, what it counts, and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of a win and of a draw.
WIN, DRAW = 3, 1


def decided(finished: Column, own: Column, other: Column) -> Column:
    """True if a result counts: it is final and both scores are known."""
    return F.coalesce(finished, F.lit(False)) & own.isNotNull() & other.isNotNull()


def verdict(counts: Column, own: Column, other: Column, names: tuple[str, str, str] = ("WIN", "DRAW", "LOSS")) -> Column:
    """Name of the outcome for the own side; null unless it counts."""
    won, drawn, lost = names
    return F.when(counts, F.when(own > other, won).when(own < other, lost).otherwise(drawn))


def points(counts: Column, own: Column, other: Column) -> Column:
    """Points for the own side; null unless the result counts."""
    return F.when(counts, F.when(own > other, WIN).when(own == other, DRAW).otherwise(0))


def rate(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, rounded half up; null if whole is not positive."""
    return F.when(whole > 0, F.round(part / whole, digits))


def share_of(parts: Column, wholes: Column, digits: int) -> Column:
    """Ratio of sums: what the average of rates would get wrong."""
    return rate(F.sum(parts), F.sum(wholes), digits)
