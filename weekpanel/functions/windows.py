"""Row-based window expressions.

All functions count rows, not calendar weeks. They take the ordered window of the entity so that
one plan uses one window spec: Spark then plans one exchange and one sort for all of them. The
entity windows run on tables with one row per entity and week (or statement date), so the rows of
one window are bounded by the calendar, never by the traffic of an entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from weekpanel.functions.numeric import as_flag, safe_divide


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def entity_window(keys: Sequence[str] | str, order: str | Column) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(_c(order).asc_nulls_last())


def pct_change(x: Column | str, k: int, w: WindowSpec) -> Column:
    return safe_divide(x, F.lag(_c(x), k).over(w)) - 1


def _full(x: Column, n: int, w: WindowSpec, value) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, value(frame))


def rolling_std(x: Column | str, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation of the last n rows; NULL until all n are present."""
    return _full(_c(x), n, w, lambda f: F.stddev_samp(_c(x)).over(f))


def rolling_sum(x: Column | str, n: int, w: WindowSpec) -> Column:
    return _full(_c(x), n, w, lambda f: F.sum(_c(x)).over(f))


def rolling_max(x: Column | str, n: int, w: WindowSpec) -> Column:
    return _full(_c(x), n, w, lambda f: F.max(_c(x)).over(f))


def moving_average(x: Column | str, n: int, w: WindowSpec) -> Column:
    """Mean of up to n rows (no minimum)."""
    return F.avg(_c(x)).over(w.rowsBetween(-(n - 1), 0))


def drawdown(x: Column | str, n: int, w: WindowSpec) -> Column:
    return safe_divide(x, rolling_max(x, n, w)) - 1


def forward_fill(x: Column | str, w: WindowSpec) -> Column:
    """Last value that is not missing, per column."""
    return F.last(_c(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def anchored(x: Column | str, when_present: Column | str, w: WindowSpec) -> Column:
    """Value of ``x`` at the last row where ``when_present`` was not missing."""
    return forward_fill(F.when(_c(when_present).isNotNull(), _c(x)), w)


def running_total(x: Column | str, w: WindowSpec) -> Column:
    return F.sum(_c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def difference(x: Column | str, w: WindowSpec) -> Column:
    return _c(x) - F.lag(_c(x), 1).over(w)


def zero_between_positive(x: Column | str, w: WindowSpec) -> Column:
    """1 where a zero stands between two positive neighbours."""
    c = _c(x)
    return as_flag((c == 0) & (F.lag(c, 1).over(w) > 0) & (F.lead(c, 1).over(w) > 0))


def zscore(x: Column | str, keys: Sequence[str] | str) -> Column:
    """Standard score in the group: missing stays missing, no spread gives 0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    g = Window.partitionBy(*keys)
    c = _c(x)
    sd = F.stddev_samp(c).over(g)
    flat = sd.isNull() | (sd == 0)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(flat, F.lit(0.0)).otherwise(
        (c - F.avg(c).over(g)) / sd
    )
