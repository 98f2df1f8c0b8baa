"""Prices, fundamentals and sector codes as one panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import NEXT_PRICE, TARGET
from weekpanel.operators.rows import rename_reorder

UNADJUSTED = ["ClosePrice", "ClosePrice_t-1", "ClosePrice_t-2", "ClosePrice_t+1"]


def merge_panel(prices: DataFrame, fundamentals: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Inner join on ticker and week, sector code added, key and targets first.

    Both inputs hold one row per key and come out of windows partitioned by ticker.
    """
    left = rename_reorder(prices, {}, drop_ignoring_case=UNADJUSTED)
    right = rename_reorder(fundamentals, {"symbol": "Ticker"}, drop_ignoring_case=["company_name", "companyName"])
    out = left.join(right, ["WeekEndingFriday", "Ticker"], "inner")
    if universe is not None:
        out = out.join(universe.select("Ticker", "SectorCode"), "Ticker", "left")
    return rename_reorder(out, {}, ["WeekEndingFriday", "Ticker", NEXT_PRICE, TARGET])


def complete_case(panel: DataFrame, drop: tuple[str, ...] = ("WeekEndingFriday", "Ticker")) -> DataFrame:
    """Feature rows without ids and without missing values."""
    kept = panel.select(*[F.col(f"`{c}`") for c in panel.columns if c not in drop])
    return kept.na.drop("any", subset=[f"`{c}`" for c in kept.columns])
