"""Aggregates over decided two-sided results (columns result, points, goals_for, goals_against)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rate
from .rows import ranked, running_totals

_STANDING = ("points", "goal_difference", "goals_for")


def record(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Matches, wins, draws, losses, goals and points of each group, over rows that have a result."""
    outcome = lambda name: F.count_if(F.col("result") == name)
    sums = [F.sum(c).cast("long").alias(c) for c in ("goals_for", "goals_against", "points")]
    return df.where("result is not null").groupBy(*by).agg(F.count("*").alias("matches_played"), outcome("WIN").alias("wins"), outcome("DRAW").alias("draws"), outcome("LOSS").alias("losses"), *sums)


def season_table(df: DataFrame, side: str, season: Sequence[str]) -> DataFrame:
    """``record`` of each side and season with rates, and its rank in the season."""
    n = F.col("matches_played")
    made = record(df, [side, *season]).withColumns({"goal_difference": F.col("goals_for") - F.col("goals_against"), "points_per_game": rate(F.col("points"), n, 2), "win_rate": rate(F.col("wins"), n, 3)})
    return ranked(made, season, [F.col(c).desc() for c in _STANDING], "season_rank")


def venue_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``record`` of each group with averages and outcome rates."""
    n = F.col("matches_played")
    two = {"avg_goals_for": "goals_for", "avg_goals_against": "goals_against", "points_per_game": "points"}
    three = {"win_rate": "wins", "draw_rate": "draws", "loss_rate": "losses"}
    return record(df, by).withColumns({k: rate(F.col(c), n, 2) for k, c in two.items()} | {k: rate(F.col(c), n, 3) for k, c in three.items()})


def progress_table(df: DataFrame, side: str, table: Sequence[str], step: str) -> DataFrame:
    """Points and goals of each side at each step, what they add up to so far, and the position this gives."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("points", "goals_for", "goals_against")]
    steps = df.where(F.col("result").isNotNull() & F.col(step).isNotNull()).groupBy(side, *table, step).agg(*sums)
    total = running_totals(steps, [side, *table], [step], {f"cumulative_{c}": c for c in ("points", "goals_for", "goals_against")})
    total = total.withColumn("cumulative_goal_difference", F.col("cumulative_goals_for") - F.col("cumulative_goals_against"))
    return ranked(total, [*table, step], [F.col(f"cumulative_{c}").desc() for c in _STANDING], "position")
