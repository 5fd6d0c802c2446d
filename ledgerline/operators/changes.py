"""What changed from capture to capture of a snapshot table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh, named, spelled


def captures_of(df: DataFrame, capture: str) -> DataFrame:
    """(captured, before, days): each capture with the one before it and the days between; one row for each capture."""
    order = Window.orderBy("captured")  # as many rows as captures
    found = df.select(named(capture).alias("captured")).where(F.col("captured").isNotNull()).distinct()
    return found.withColumn("before", F.lag("captured").over(order)).withColumn("days", F.date_diff("captured", "before").cast("int"))


def latest_capture(df: DataFrame, capture: str, condition: Column | None = None) -> DataFrame:
    """The rows of the last capture (of those with a row for which ``condition`` holds).

    The capture is a scalar subquery.  Spark runs it first and then reads only
    that partition, if the table is partitioned by the capture; the subquery
    itself reads no data but what the condition needs.
    """
    (own,) = spelled(df, [capture])
    asked = df if condition is None else df.where(condition)
    return df.where(named(own) == asked.agg(F.max(named(own))).scalar())


def capture_gaps(df: DataFrame, capture: str, step: int = 1) -> DataFrame:
    """(captured, before, days) of captures that come more than ``step`` days after the one before."""
    return captures_of(df, capture).where(F.col("days") > step)


def _comparable(kind: T.DataType, value: Column) -> Column:
    """Maps, and what holds one or a VARIANT, are compared as JSON."""
    return F.to_json(F.struct(value.alias("x"))) if any(k in kind.simpleString() for k in ("map<", "variant")) else value


def change_feed(df: DataFrame, keys: Sequence[str], capture: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(captured, keys, change, changed, days, old, new): how each capture differs from the one before it.

    change is "inserted", "changed" or "deleted", changed lists the columns with
    other values in the order of the table, old and new are the rows' values as
    structs, days is the distance of the captures.  Rows that stay the same are
    left out, as is the first capture, which has none before it.  A key with a
    null is a key; rows of a capture without a date are left out; ``ignore``
    names columns that make no change, such as load times.  A key has one row
    in a capture.

    Every row meets the next capture's row of its key in one full outer join,
    whatever the number of captures.
    """
    keys, (capture,) = spelled(df, keys), spelled(df, [capture])
    keys = [k for k in keys if k != capture]
    left_out = {c.lower() for c in [*keys, capture, *spelled(df, ignore)]}
    fields = [f for f in df.schema if f.name.lower() not in left_out]
    step = captures_of(df, capture)
    key = lambda side: [named(k).alias(f"{side}{i}") for i, k in enumerate(keys)]
    row = F.struct(*[named(f.name) for f in fields]) if fields else F.struct(F.lit(0).alias("none"))
    at = named(capture)
    now = df.where(at.isNotNull()).select(at.alias("now_at"), *key("now_"), row.alias("now"))
    # A row as the capture after it sees it.
    following = step.where("before is not null").select(F.col("before").alias("then_from"), F.col("captured").alias("then_at"))
    then = df.where(at.isNotNull()).select(at.alias("then_from"), *key("then_"), row.alias("then")).join(F.broadcast(following), "then_from")
    same = F.col("now_at") == F.col("then_at")
    for i in range(len(keys)):
        same = same & F.col(f"now_{i}").eqNullSafe(F.col(f"then_{i}"))
    met = now.join(then, same, "full_outer")
    is_new, is_old = F.col("now").isNotNull(), F.col("then").isNotNull()
    other = lambda f: ~_comparable(f.dataType, F.col("now").getField(f.name)).eqNullSafe(_comparable(f.dataType, F.col("then").getField(f.name)))
    changed = F.array_compact(F.array(*[F.when(is_new & is_old & other(f), f.name) for f in fields])) if fields else F.array().cast("array<string>")
    kind = F.when(is_new & is_old, F.when(F.size("changed") > 0, "changed")).when(is_new, "inserted").otherwise("deleted")
    names = [fresh(n, keys) for n in ("captured", "change", "changed", "days", "old", "new")]
    found = met.withColumn("changed", changed).withColumn("kind", kind).withColumn("captured", F.coalesce("now_at", "then_at")).where("kind is not null")
    dated = found.join(F.broadcast(step.where("before is not null")), "captured")
    values = [F.coalesce(F.col(f"now_{i}"), F.col(f"then_{i}")).alias(k) for i, k in enumerate(keys)]
    return dated.select(F.col("captured").alias(names[0]), *values, F.col("kind").alias(names[1]), F.col("changed").alias(names[2]), F.col("days").alias(names[3]), F.col("then").alias(names[4]), F.col("now").alias(names[5]))
