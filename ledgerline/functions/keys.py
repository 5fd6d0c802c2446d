"""Keys of the dimensional model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key of the member that stands for "not known" in every dimension.
UNKNOWN_KEY = -1
#: Surrogate keys stay under this prime, so they fit 32 signed bits.
KEY_SPACE = 2_147_483_647


def surrogate_key(natural: Column | str, method: str = "xxhash64") -> Column:
    """A positive 31-bit key that depends on the natural key alone; UNKNOWN_KEY for null.

    "xxhash64" hashes the value in its own type, "md5" its text form, which
    other engines can reproduce.
    """
    c = F.col(natural) if isinstance(natural, str) else natural
    if method == "xxhash64":
        hashed = F.xxhash64(c)
    elif method == "md5":
        hashed = F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")
    else:
        raise ValueError(f"unknown key method {method!r}")
    return F.when(c.isNull(), UNKNOWN_KEY).otherwise(F.pmod(hashed, F.lit(KEY_SPACE))).cast("int")


def date_key(day: Column | str) -> Column:
    """yyyymmdd as an integer; UNKNOWN_KEY for null."""
    c = F.col(day) if isinstance(day, str) else day
    return F.coalesce((F.year(c) * 10_000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int"), F.lit(UNKNOWN_KEY))


def period_label(start: Column | str, end: Column | str) -> Column:
    """"2026" for a period in one year or without an end, "2025/26" across two, "Unknown" without a start."""
    first, last = F.year(start), F.year(end)
    both = F.format_string("%d/%02d", first, last % 100)
    return F.when(first.isNull(), "Unknown").when(last.isNull() | (first == last), first.cast("string")).otherwise(both)


def period_key(label: Column | str, method: str = "xxhash64") -> Column:
    """Surrogate key of a label; UNKNOWN_KEY for "Unknown"."""
    c = F.col(label) if isinstance(label, str) else label
    return surrogate_key(F.nullif(c, F.lit("Unknown")), method)
