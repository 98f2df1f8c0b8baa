"""Daily prices to weekly bars and price features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import PRICE_COLUMNS
from weekpanel.functions.dates import week_ending_friday
from weekpanel.functions.numeric import direction
from weekpanel.functions.windows import drawdown, entity_window, pct_change, rolling_std
from weekpanel.operators.rows import drop_incomplete


def weekly_bars(daily: DataFrame) -> DataFrame:
    """Last trading day of every week. One row per ticker and day in, one per ticker and week out.

    ``max_by`` combines before the shuffle, so a ticker with a third of all days ships one row per
    week and task.
    """
    day = F.col("ActualTradingDate")
    return daily.filter(day.isNotNull()).groupBy("Ticker", week_ending_friday(day).alias("WeekEndingFriday")).agg(
        F.max_by("ClosePrice", day).alias("ClosePrice"), F.max_by("AdjClosePrice", day).alias("AdjClosePrice")
    )


def price_features_all(bars: DataFrame) -> DataFrame:
    """All weeks with the features still missing at both ends of a ticker.

    Every expression uses the same window, so Spark plans one exchange and one sort by ticker.
    """
    w = entity_window("Ticker", "WeekEndingFriday")
    adj = F.col("AdjClosePrice")
    moved = bars.select(
        "WeekEndingFriday", "Ticker", "ClosePrice", "AdjClosePrice",
        *[F.lag(c, k).over(w).alias(f"{c}_t-{k}") for c in ("ClosePrice", "AdjClosePrice") for k in (1, 2)],
        *[F.lead(c, 1).over(w).alias(f"{c}_t+1") for c in ("ClosePrice", "AdjClosePrice")],
        pct_change(adj, 1, w).alias("WeeklyReturn_1W"),
        pct_change(adj, 4, w).alias("WeeklyReturn_4W"),
        pct_change(adj, 12, w).alias("Momentum_12W"),
        drawdown(adj, 12, w).alias("Drawdown_12W"),
    )
    return moved.withColumns({
        "AdjClosePrice_t+1_Up": direction("`AdjClosePrice_t+1`", adj),
        "Volatility_4W": rolling_std("WeeklyReturn_1W", 4, w),
        "Volatility_12W": rolling_std("WeeklyReturn_1W", 12, w),
    }).select(*[F.col(f"`{c}`") for c in PRICE_COLUMNS])


def price_features(bars: DataFrame) -> DataFrame:
    """Complete weeks only: the first 12 weeks and the last week of a ticker fall away."""
    return drop_incomplete(price_features_all(bars))
