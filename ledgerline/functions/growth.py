"""How the type of a column may grow from load to load."""

from __future__ import annotations

from pyspark.sql import types as T

#: Whole numbers by size, with their decimal digits: fixed values of the types.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_FLOATING = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _is_number(kind: T.DataType) -> bool:
    return type(kind) in _WHOLE or isinstance(kind, (*_FLOATING, T.DecimalType))


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least type that takes the values of both; None if they have nothing in common.

    Whole numbers grow by size and into decimals; any number grows into a
    double, which rounds what it cannot hold; dates grow into timestamps; a
    column that was all null grows into anything.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return max(a, b, key=lambda kind: _WHOLE[type(kind)])
    if _is_number(a) and _is_number(b):
        if isinstance(a, _FLOATING) or isinstance(b, _FLOATING):
            return T.DoubleType()
        digits = [(kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (_WHOLE[type(kind)], 0) for kind in (a, b)]
        whole, scale = (max(x) for x in zip(*digits))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    for one, other in ((a, b), (b, a)):
        if isinstance(one, T.DateType) and isinstance(other, _TIMES):
            return other
    return None
