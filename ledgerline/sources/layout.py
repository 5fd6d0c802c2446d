"""Orders of rows over files that let readers skip files by predicates on any of several columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.names import fresh, named, spelled

#: Bits of a column's place among its quantiles, and columns at most: their bits together fit a long.
BITS, MOST = 7, 8
#: Bytes of a text that its place is taken from.
_HEAD = 6


def _number(name: str, kind: T.DataType) -> Column:
    """A double that orders rows as the column does; of texts the first bytes count."""
    c = named(name)
    if isinstance(kind, T.StringType):
        head = F.substring(F.encode(c, "UTF-8"), 1, _HEAD)
        return F.conv(F.rpad(F.hex(head), 2 * _HEAD, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"rows have no order by {name}, a {kind.simpleString()}")


def with_interleaved_key(df: DataFrame, by: Sequence[str], key: str, bits: int = BITS) -> DataFrame:
    """``df`` with a long ``key`` that takes turns with the bits of each column's place among its quantiles, high bits first; nulls come first.

    The quantiles are approximate and of all rows, 2 ** bits - 1 for each
    column: these alone reach the driver.
    """
    if not 0 < len(by) <= MOST:
        raise ValueError(f"from one to {MOST} columns can be interleaved")
    numbers = [_number(c, df.schema[c].dataType) for c in spelled(df, by)]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(n), n), shares, 10_000).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
    places = {}
    for i, n in enumerate(numbers):
        cuts = F.array(*[F.lit(float(c)) for c in sorted(set(found[f"q{i}"] or []))]).cast("array<double>")
        # Columns of their own, as each bit of the key reads them.
        places[fresh(f"place{i}", df.columns, [key])] = (cuts, n)
    placed = df.withColumns({name: F.when(n.isNull(), 0).otherwise(_below(cuts, n)).cast("long") for name, (cuts, n) in places.items()})
    turns = [F.shiftleft(F.shiftright(named(p), b).bitwiseAND(F.lit(1).cast("long")), b * len(places) + i) for i, p in enumerate(places) for b in range(bits)]
    return placed.withColumn(key, reduce(lambda a, b: a.bitwiseOR(b), turns)).drop(*places)


def _below(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def interleaved(df: DataFrame, by: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """The same rows in ``files`` ranges of their interleaved key, so that each file is narrow in all of the columns."""
    key = fresh("turn", df.columns)
    return with_interleaved_key(df, by, key, bits).repartitionByRange(files, key).sortWithinPartitions(key).drop(key)


def files_touched(df: DataFrame, ranges: Sequence[tuple[str, object, object]]) -> DataFrame:
    """(column, n_files, n_touched): how many of the files that ``df`` reads may have rows from ``low`` to ``high`` in the column, for each (column, low, high).

    Judged by the least and greatest values of the files, as readers do.
    """
    columns = spelled(df, list(dict.fromkeys(c for c, _, _ in ranges)))
    place = {c.lower(): i for i, c in enumerate(columns)}
    ends = [f(named(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*ends)
    tests = [F.struct(F.lit(c).alias("column"), ((F.col(f"low{place[c.lower()]}") <= F.lit(high)) & (F.col(f"high{place[c.lower()]}") >= F.lit(low))).alias("met")) for c, low, high in ranges]
    return files.select(F.explode(F.array(*tests)).alias("t")).groupBy("t.column").agg(F.count("*").alias("n_files"), F.count_if("t.met").alias("n_touched"))
