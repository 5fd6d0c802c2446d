"""Connected components of an edge list, by alternating star contraction.

Every step is a join or a grouped minimum on Spark; no links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link down at most, and none if a link leads to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    rest = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): root is the least node reachable; roots themselves are left out.

    Self links and repeated links are allowed; an empty edge list gives no rows.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", tidy=True)
    for _ in range(rounds):
        if _settled(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # Each half is written: the second reads its input several times, so in one plan the first would stand there as often.
        for step in (_large_star, _small_star):
            last, current = current, materialize(step(current), "edges", tidy=True)
            discard(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
