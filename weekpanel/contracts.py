"""Names, fixed values and fail-fast checks of the tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("Ticker", "WeekEndingFriday")
TARGET = "AdjClosePrice_t+1_Up"
NEXT_PRICE = "AdjClosePrice_t+1"

# Columns of the weekly price table.
PRICE_COLUMNS = [
    "WeekEndingFriday", "Ticker",
    "ClosePrice", "ClosePrice_t-1", "ClosePrice_t-2", "ClosePrice_t+1",
    "AdjClosePrice", "AdjClosePrice_t-1", "AdjClosePrice_t-2", "AdjClosePrice_t+1",
    "AdjClosePrice_t+1_Up",
    "WeeklyReturn_1W", "WeeklyReturn_4W", "Momentum_12W",
    "Volatility_4W", "Volatility_12W", "Drawdown_12W",
]

# Flow items summed over four quarters.
FLOW_ITEMS = ["revenue", "grossProfit", "operatingIncome", "netIncome", "operatingCashFlow", "freeCashFlow"]

# The two feature families of the fundamentals table.
MARKET_FEATURES = [
    "BookToMarket", "MarketCap", "FreeCashFlowYield", "FreeCashFlowYield_TTM", "EarningsYield", "EarningsYield_TTM",
]
STATEMENT_FEATURES = [
    "GrossProfitability", "GrossProfitability_TTM", "OperatingMargin", "OperatingMargin_TTM", "ROA", "ROA_TTM",
    "AssetGrowth", "InvestmentIntensity", "Accruals", "Accruals_TTM", "DebtToAssets", "WorkingCapitalScaled",
]

# Sector labels and codes.
SECTOR_CODES = {
    "Basic Materials": 1, "Communication Services": 2, "Consumer Cyclical": 3, "Consumer Defensive": 4,
    "Energy": 5, "Financial Services": 6, "Healthcare": 7, "Industrials": 8, "Real Estate": 9,
    "Technology": 10, "Utilities": 11,
}

# Tickers never selected into the universe.
EXCLUDED_TICKERS = [
    "GEV", "TBB", "RCB", "PLTR", "HSBC", "BAC", "JPM", "WFC", "MUFG", "CTA-PA", "HDB", "PUK", "NGG",
    "BBDO", "SOJE", "SOJD", "SOJC", "GOOGL", "PDD", "SNAP", "BEKE", "WEC",
]

# News columns that enter the modeling table.
MODEL_NEWS_COLUMNS = [
    "NEWS_FINBERT_Negative_Mean", "NEWS_FINBERT_Neutral_Mean", "NEWS_FINBERT_Positive_Mean",
    "NEWS_Sentiment_Mean", "NEWS_FINBERT_Granger_Score",
]

# Models that count as baselines.
BASELINES = ["null_model", "always_one_model", "always_zero_model"]


def fundamentals_columns() -> list[str]:
    """Output features of the fundamentals table, generated from the two families."""
    out = ["QuarterlyReleased"]
    for suffix in ("", "_L1W", "_L2W"):
        out += [c + suffix for c in MARKET_FEATURES]
    for suffix in ("", "_L1Q", "_L2Q"):
        out += [c + suffix for c in STATEMENT_FEATURES]
    return out


class ContractError(ValueError):
    """A table does not have the promised columns, keys or values."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row (partial counts are combined before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ContractError(f"duplicate keys {list(keys)}: {[tuple(r)[:-1] for r in found]}")
    return df


def unknown_values(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    """Non-empty values outside the domain."""
    c = F.trim(F.col(column))
    return df.filter(c.isNotNull() & (c != "") & ~c.isin(list(domain))).select(c.alias(column)).distinct()


def assert_known(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    found = unknown_values(df, column, domain).limit(20).collect()
    if found:
        raise ContractError(f"unknown {column}: {sorted(r[0] for r in found)}")
    return df


def assert_not_empty(**frames: DataFrame) -> None:
    empty = [name for name, df in frames.items() if df.isEmpty()]
    if empty:
        raise ContractError(f"empty: {empty}")
