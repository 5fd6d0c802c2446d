"""Column names of any form: quoted when used, compared without case, and new ones that meet no other."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, *columns: Iterable[str]) -> str:
    """``name``, lengthened until none of the given names is like it."""
    taken = {c.lower() for group in columns for c in group}
    while name.lower() in taken:
        name += "_"
    return name


def spelled(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names as ``df`` spells them; one that it lacks is an error."""
    own = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in own]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return [own[n.lower()] for n in names]


def all_names(*columns: Sequence[str]) -> list[str]:
    """The names of all lists in their order, each once."""
    found: dict[str, str] = {}
    for group in columns:
        for c in group:
            found.setdefault(c.lower(), c)
    return list(found.values())
