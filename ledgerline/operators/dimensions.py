"""Builders of dimensions: calendar, described members, late members and the unknown one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import UNKNOWN_KEY, date_key


def with_unknown(df: DataFrame, members: Mapping[str, object]) -> DataFrame:
    """``df`` and one row with the given values, null elsewhere."""
    row = df.sparkSession.range(1).select(*[F.lit(members.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(row)


def calendar(*dates: DataFrame) -> DataFrame:
    """Every day from the least to the greatest of the frames' only columns, described, and the unknown day.

    The bounds stay in the plan.  Without any date only the unknown day is left.
    """
    bounds = reduce(DataFrame.union, [d.agg(F.min(d.columns[0]).alias("a"), F.max(d.columns[0]).alias("b")) for d in dates]).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    days = bounds.where("a is not null").select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"), F.expr("interval 1 day"))).alias("full_date"))
    d = F.col("full_date")
    described = days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day_of_month"), F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("iso_week"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )
    return with_unknown(described, {"date_key": UNKNOWN_KEY, "month_name": "Unknown", "day_name": "Unknown", "is_weekend": False})


def enriched(df: DataFrame, reference: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """``df`` with the columns of a small literal table; missing ones take their defaults."""
    joined = df.join(F.broadcast(reference), list(on), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def with_late_members(known: DataFrame, seen: Sequence[DataFrame], key: str, copy: Mapping[str, str] = {}) -> DataFrame:
    """``known`` members and a stub for every key seen elsewhere, marked by ``is_inferred``.

    A stub has the greatest value of each column that a seen frame offers;
    ``copy`` (column -> column) fills others from these.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seen).where(F.col(key).isNotNull())
    stubs = every.groupBy(key).agg(*[F.max(c).alias(c) for c in every.columns if c != key]).join(known.select(key).distinct(), key, "left_anti")
    stubs = stubs.withColumns({new: F.col(old) for new, old in copy.items()}).withColumn("is_inferred", F.lit(True))
    return known.withColumn("is_inferred", F.lit(False)).unionByName(stubs, allowMissingColumns=True)


def periods(df: DataFrame, start: str, end: str, label: Column, as_of: Column) -> DataFrame:
    """(label, start_year, is_current) of each period; is_current if ``as_of`` lies in any of its ranges."""
    rows = df.select(F.col(start).alias("s"), F.col(end).alias("e"), label.alias("label")).distinct().where("label <> 'Unknown'")
    current = F.coalesce(as_of.between(F.col("s"), F.col("e")), F.lit(False))
    return rows.groupBy("label").agg(F.min(F.year("s")).alias("start_year"), F.bool_or(current).alias("is_current"))
