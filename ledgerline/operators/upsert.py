"""Merging keyed rows into what is there."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.growth import wider
from .names import all_names, fresh, named, spelled
from .rows import latest_per_key

ORIGINS = ("inserted", "updated", "kept")


def marked(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), origin: str = "_origin") -> DataFrame:
    """Rows after a merge with a column ``origin``: "kept", "updated" or "inserted".

    ``existing`` has one row for a key; of incoming rows with one key the first
    under ``order`` counts.  Existing rows without an incoming one stay; columns
    that one side lacks are null; a key with a null merges with its like.  A
    column whose types differ gets the wider one.  Names are compared without
    case and may hold anything; ``origin`` must be none of theirs.  Both sides
    are read once: one full outer join tells old, new and common keys.
    """
    names = all_names(existing.columns, incoming.columns)
    if fresh(origin, names) != origin:
        raise ValueError(f"there is a column {origin}")
    rows = latest_per_key(incoming, keys, order)
    sides = {}
    for side, frame in (("old", existing), ("new", rows)):
        sides[side] = frame.select(*[named(k).alias(f"{side}{i}") for i, k in enumerate(spelled(frame, keys))], F.struct(*map(named, frame.columns)).alias(side))
    same = reduce(lambda a, b: a & b, [F.col(f"old{i}").eqNullSafe(F.col(f"new{i}")) for i in range(len(keys))])
    is_new, is_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    fields = {side: {f.name.lower(): f for f in frame.schema} for side, frame in (("old", existing), ("new", incoming))}

    def value(name: str) -> Column:
        old, new = (fields[side].get(name.lower()) for side in ("old", "new"))
        kind = wider(*(f.dataType for f in (old, new))) if old and new else (old or new).dataType
        if kind is None:
            raise ValueError(f"column {name} is {old.dataType.simpleString()} and gets {new.dataType.simpleString()}")
        of = lambda side, f: F.col(side).getField(f.name).cast(kind) if f else F.lit(None).cast(kind)
        return F.when(is_new, of("new", new)).otherwise(of("old", old)).alias(name)

    where = F.when(is_new & is_old, "updated").when(is_new, "inserted").otherwise("kept")
    return sides["old"].join(sides["new"], same, "full_outer").select(*map(value, names), where.alias(origin))


def merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """State after the merge."""
    origin = fresh("origin", existing.columns, incoming.columns)
    return marked(existing, incoming, keys, order, origin).drop(origin)


def merge_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """(inserted, updated, kept): one row."""
    origin = fresh("origin", existing.columns, incoming.columns)
    rows = marked(existing, incoming, keys, order, origin)
    return rows.agg(*[F.count_if(F.col(origin) == o).alias(o) for o in ORIGINS])


def without(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows after a delete: those for which the predicate is false or null."""
    return df.where(~F.coalesce(predicate, F.lit(False)))
