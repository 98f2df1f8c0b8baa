"""Arithmetic with NULL as the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """``a / b``; NULL when the denominator is zero or missing."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def to_double(x: Column | str) -> Column:
    """Number from anything; text that is no number and NaN become NULL."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def as_flag(condition: Column) -> Column:
    """1 / 0; a comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def outflow(x: Column | str) -> Column:
    """Spending with one sign: minus the absolute value."""
    return -F.abs(_c(x))


def pct(part: Column | str, total: Column | str, digits: int = 2) -> Column:
    """Share of a total in percent."""
    return F.round(safe_divide(_c(part) * F.lit(100.0), total), digits)


def null_where(x: Column | str, flag: Column | str) -> Column:
    """NULL where the flag is 1."""
    return F.when(F.coalesce(_c(flag) == 1, F.lit(False)), F.lit(None)).otherwise(_c(x))


def sentiment(positive: Column | str, negative: Column | str) -> Column:
    return _c(positive) - _c(negative)


def direction(next_value: Column | str, value: Column | str) -> Column:
    """1 when the next value is higher, else 0."""
    return as_flag(_c(next_value) > _c(value))
