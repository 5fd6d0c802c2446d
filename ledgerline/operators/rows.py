"""Choosing, ordering and unfolding rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh, named, spelled


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row of each key: the first under ``order``.

    Ties are settled by the other columns in their order, so the choice does not
    depend on how rows are dealt to tasks.  Null keys are a key.  Columns may
    have any names.
    """
    keys, place = spelled(df, keys), fresh("place", df.columns)
    rest = [f for f in df.schema if f.name not in keys]
    # Maps and VARIANTs, and what holds one, have no order.
    ties = [F.to_json(F.struct(named(f.name))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else named(f.name) for f in rest]
    window = Window.partitionBy(*map(named, keys)).orderBy(*order, *(ties or map(named, keys)))
    return df.withColumn(place, F.row_number().over(window)).where(F.col(place) == 1).drop(place)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its rank inside ``by``: equals share a rank, the next is skipped."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with sums up to and including each row: result name -> column."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.sum(c).over(window) for name, c in sums.items()})


def change_since(df: DataFrame, by: Sequence[str], order: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """``df`` with the difference to the row before in its group: result name -> column; null for the first."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({name: F.col(c) - F.lag(c).over(window) for name, c in measures.items()})


def two_sided(df: DataFrame, sides: Mapping[str, Mapping[str, str | Column]], label: str) -> DataFrame:
    """Each row once for every side, in one pass.

    sides: label value -> {result name: column}; the other columns stay as they are.
    """
    used = {c for columns in sides.values() for c in columns.values() if isinstance(c, str)}
    made = [F.struct(F.lit(value).alias(label), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]) for value, columns in sides.items()]
    rest = [c for c in df.columns if c not in used]
    return df.select(*rest, F.explode(F.array(*made)).alias("_side")).select(*rest, "_side.*")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)
