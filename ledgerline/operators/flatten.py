"""Nested documents to rows: paths to columns, with arrays unfolded on the way."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, columns: Mapping[str, str | Column], unfold: Sequence[str | tuple[str, str]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Select ``columns`` (name -> path or expression) after unfolding arrays.

    unfold lists (array path, element name) in order; a later path may start
    with an earlier element name.  A null or empty array gives no rows.  ``keep``
    are columns taken as they are.
    """
    rows = df
    for step in unfold:
        path, name = (step, step.rpartition(".")[2]) if isinstance(step, str) else step
        rows = rows.withColumn(name, F.explode(F.col(path)))
    picked = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return rows.select(*picked, *keep)


def first_of(*paths: str, default: str | None = None) -> Column:
    """The first path that is not null, else ``default``."""
    tail = [] if default is None else [F.lit(default)]
    return F.coalesce(*[F.col(p) for p in paths], *tail)


def element(path: str, i: int) -> Column:
    """Element ``i`` of an array, null if it is shorter."""
    return F.get(F.col(path), F.lit(i))


def size_or_zero(path: str) -> Column:
    """Number of elements; a missing array has none."""
    return F.coalesce(F.size(F.col(path)), F.lit(0))
