"""Casts that never raise, and the notion of drift: a value that was there and did not survive its cast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_cast(value: Column | str, to: str, fmt: str | None = None) -> Column:
    """``value`` as type ``to``, null where it does not fit; ``fmt`` is a pattern for dates and timestamps."""
    c = F.col(value) if isinstance(value, str) else value
    if fmt is not None:
        if to not in ("date", "timestamp", "timestamp_ntz"):
            raise ValueError(f"a format has no meaning for {to}")
        return F.try_to_timestamp(c, F.lit(fmt)).try_cast(to)
    return c.try_cast(to)


@dataclass(frozen=True)
class Cast:
    """One cast of a typed table: from column ``source`` to column ``name`` of type ``to``."""

    source: str
    name: str
    to: str
    fmt: str | None = None

    def column(self) -> Column:
        return checked_cast(self.source, self.to, self.fmt).alias(self.name)


def has_drift(casts: Sequence[tuple[Column, Column]]) -> Column:
    """True if any (source, result) pair has a source but no result."""
    return reduce(lambda a, b: a | b, [source.isNotNull() & result.isNull() for source, result in casts], F.lit(False))


def clock_seconds(text: Column | str) -> Column:
    """Seconds of "HH:MM:SS.fff"; null if a part is missing or not a number."""
    parts = F.split(text, ":")
    hours, minutes, seconds = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    return hours * 3600 + minutes * 60 + seconds


def json_leaf(text: Column | str, schema: str, leaf: str) -> Column:
    """A leaf of JSON text read under a declared schema; a value of another type is null, its neighbours stay."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})[leaf]
