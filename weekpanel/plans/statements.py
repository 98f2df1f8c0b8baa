"""Four quarterly statements to one raw table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.operators.rows import best_per_key, pick_field
from weekpanel.operators.sets import shared_columns

# Join keys in order, and the source names of every field.
MERGE_KEYS = ["requested_symbol", "symbol", "date", "fiscalYear", "period"]
METADATA = ["requested_symbol", "symbol", "date", "fiscalYear", "period", "filingDate", "acceptedDate", "reportedCurrency", "cik"]
INCOME_FIELDS = {
    "revenue": ["revenue"], "grossProfit": ["grossProfit"], "operatingIncome": ["operatingIncome"],
    "netIncome": ["netIncome", "bottomLineNetIncome"], "interestExpense": ["interestExpense"],
    "weightedAverageShsOut": ["weightedAverageShsOut"], "weightedAverageShsOutDil": ["weightedAverageShsOutDil"],
}
BALANCE_FIELDS = {
    "totalAssets": ["totalAssets"],
    "totalStockholdersEquity": ["totalStockholdersEquity", "totalEquity"],
    "totalCurrentAssets": ["totalCurrentAssets"], "totalCurrentLiabilities": ["totalCurrentLiabilities"],
    "totalDebt": ["totalDebt"], "cashAndCashEquivalents": ["cashAndCashEquivalents"],
}
CASH_FLOW_FIELDS = {
    "operatingCashFlow": ["operatingCashFlow"], "capitalExpenditure": ["capitalExpenditure"], "freeCashFlow": ["freeCashFlow"],
}
VALUE_FIELDS = {"marketCap": ["marketCapitalization", "marketCap"]}


def _newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    dates = [c for c in ("acceptedDate", "filingDate", "fillingDate", "date") if c in df.columns and c not in keys]
    ties = [c for c in df.columns if c not in (*keys, *dates)]
    return best_per_key(df, keys, [F.col(c) for c in dates], ties)


def _fields(df: DataFrame, keys: Sequence[str], mapping: Mapping[str, Sequence[str]], per_row: bool) -> DataFrame:
    return df.select(*keys, *[pick_field(df, names, per_row).alias(out) for out, names in mapping.items()])


def merge_statements(income: DataFrame, balance: DataFrame, cash: DataFrame, values: DataFrame,
                     per_row_fallback: bool = False) -> DataFrame:
    """Income joined to balance and cash flow (inner) and to market values (left).

    Each pair joins on the candidate keys both sides have, after keeping the newest row per key.
    """
    sides = {"balance": (balance, BALANCE_FIELDS, "inner"), "cash": (cash, CASH_FLOW_FIELDS, "inner"),
             "values": (values, VALUE_FIELDS, "left")}
    keys = {n: shared_columns(MERGE_KEYS, income, df) for n, (df, _, _) in sides.items()}
    empty = [n for n, k in keys.items() if not k]
    if empty:
        raise ValueError(f"no shared key with {empty}")
    head = _newest(income, keys["balance"])
    out = head.select(
        *[c for c in METADATA if c in income.columns],
        *[pick_field(head, names, per_row_fallback).alias(o) for o, names in INCOME_FIELDS.items()],
    )
    for n, (df, mapping, how) in sides.items():
        out = out.join(_fields(_newest(df, keys[n]), keys[n], mapping, per_row_fallback), keys[n], how)
    fields = [*INCOME_FIELDS, *BALANCE_FIELDS, *CASH_FLOW_FIELDS, *VALUE_FIELDS]
    return out.select(*[c for c in METADATA if c in income.columns], *fields)
