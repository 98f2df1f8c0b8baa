"""Quarterly statements to point-in-time weekly features.

The order matters: factors are built on the statement timeline, mapped to release weeks, joined to
the price weeks of the ticker and only then filled forward, each column on its own. An as-of join of
whole rows would lose older values where the newest filing misses a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import FLOW_ITEMS, MARKET_FEATURES, STATEMENT_FEATURES, fundamentals_columns
from weekpanel.functions.dates import public_date, week_ending_friday
from weekpanel.functions.numeric import as_flag, null_where, outflow, safe_divide, to_double
from weekpanel.functions.windows import anchored, entity_window, forward_fill, rolling_sum, zero_between_positive
from weekpanel.operators.rows import best_per_key

ITEMS = [
    "revenue", "grossProfit", "operatingIncome", "netIncome", "totalAssets", "totalStockholdersEquity",
    "totalCurrentAssets", "totalCurrentLiabilities", "totalDebt", "operatingCashFlow", "capitalExpenditure",
    "freeCashFlow", "marketCap",
]
CARRIED = ["totalStockholdersEquity", "freeCashFlow", "freeCashFlow_TTM", "netIncome", "netIncome_TTM"]
FLAGS = ["CapexReportedZeroFlag", "FreeCashFlowZeroFlag", "FreeCashFlowTTMZeroFlag", "SuspiciousTotalDebtZeroFlag"]
LAGGED = [f"{n}_L{k}Q" for n in STATEMENT_FEATURES for k in (1, 2)]
START_DATE = "2021-01-01"


def with_release_week(statements: DataFrame) -> DataFrame:
    """Public date of each filing and the Friday on or after it; filings without any date drop out."""
    dated = statements.withColumn("PublicDate", public_date("date", "filingDate", "acceptedDate"))
    return dated.filter("PublicDate is not null").withColumn("ReleaseWeek", week_ending_friday("PublicDate"))


def newest_per_statement(released: DataFrame) -> DataFrame:
    """One row per statement date: newest accepted, then newest filing."""
    ties = [c for c in released.columns if c not in ("symbol", "date", "acceptedDate", "filingDate")]
    return best_per_key(released, ["symbol", "date"], [F.col("acceptedDate"), F.col("filingDate")], ties)


def ttm_and_flags(rows: DataFrame) -> DataFrame:
    """Numbers, one sign for capital spending, trailing sums of four quarters and the zero flags."""
    w = entity_window("symbol", "date")
    items = [to_double(c).alias(c) for c in ITEMS if c != "capitalExpenditure"]
    capex = outflow(to_double("capitalExpenditure")).alias("capitalExpenditure")
    clean = rows.select("symbol", "date", "filingDate", "acceptedDate", "ReleaseWeek", *items, capex)
    summed = clean.select(
        "*", *[rolling_sum(c, 4, w).alias(f"{c}_TTM") for c in FLOW_ITEMS],
        F.lag("totalAssets", 4).over(w).alias("_assets4"),
        zero_between_positive("totalDebt", w).alias("SuspiciousTotalDebtZeroFlag"),
        as_flag(F.col("capitalExpenditure") == 0).alias("CapexReportedZeroFlag"),
        as_flag(F.col("freeCashFlow") == 0).alias("FreeCashFlowZeroFlag"),
    )
    return summed.withColumn("FreeCashFlowTTMZeroFlag", as_flag(F.col("freeCashFlow_TTM") == 0))


def ratio_expressions() -> dict[str, Column]:
    """The twelve statement ratios after their null rules."""
    c = F.col
    mean_assets = (c("totalAssets") + c("_assets4")) / 2
    average = F.when(mean_assets > 0, mean_assets)
    assets = c("totalAssets")
    ratios = {
        "GrossProfitability": safe_divide("grossProfit", assets),
        "GrossProfitability_TTM": safe_divide("grossProfit_TTM", average),
        "OperatingMargin": safe_divide("operatingIncome", "revenue"),
        "OperatingMargin_TTM": safe_divide("operatingIncome_TTM", "revenue_TTM"),
        "ROA": safe_divide("netIncome", assets),
        "ROA_TTM": safe_divide("netIncome_TTM", average),
        "AssetGrowth": safe_divide(assets - c("_assets4"), "_assets4"),
        "InvestmentIntensity": null_where(safe_divide(-c("capitalExpenditure"), assets), "CapexReportedZeroFlag"),
        "Accruals": safe_divide(c("netIncome") - c("operatingCashFlow"), assets),
        "Accruals_TTM": safe_divide(c("netIncome_TTM") - c("operatingCashFlow_TTM"), assets),
        "DebtToAssets": null_where(safe_divide("totalDebt", assets), "SuspiciousTotalDebtZeroFlag"),
        "WorkingCapitalScaled": safe_divide(c("totalCurrentAssets") - c("totalCurrentLiabilities"), assets),
    }
    return {name: ratios[name] for name in STATEMENT_FEATURES}


def with_ratios(summed: DataFrame) -> DataFrame:
    return summed.select("*", *[e.alias(n) for n, e in ratio_expressions().items()]).drop("_assets4")


def with_quarter_lags(ratios: DataFrame, flags: bool = True) -> DataFrame:
    """Ratios one and two statements back, with a flag where the lag is missing. One window for all."""
    lagged = [
        f"lag({n}, {k}) over (partition by symbol order by date asc nulls last) as {n}_L{k}Q"
        for n in STATEMENT_FEATURES for k in (1, 2)
    ]
    out = ratios.selectExpr("*", *lagged)
    return out.selectExpr("*", *[f"int({c} is null) as {c}MissingFlag" for c in LAGGED]) if flags else out


def statement_factors(statements: DataFrame) -> DataFrame:
    """Statement-level columns the weekly panel needs, one row per symbol and statement date."""
    newest = newest_per_statement(with_release_week(statements))
    return with_quarter_lags(with_ratios(ttm_and_flags(newest)), flags=False).select(
        "symbol", "date", "filingDate", "acceptedDate", "ReleaseWeek", "marketCap", *CARRIED, *FLAGS, *STATEMENT_FEATURES, *LAGGED
    )


def align_to_weeks(factors: DataFrame, bars: DataFrame) -> DataFrame:
    """Every price week of a ticker with the statement released in it.

    A release whose Friday is not a price week is lost, as in the original. Releases before the first
    price week compete for that week: its own release wins, else the latest earlier one seeds it, and
    a seed does not count as released.
    """
    first = bars.groupBy(F.col("Ticker").alias("symbol")).agg(F.min("WeekEndingFriday").alias("_first"))
    placed = factors.join(first, "symbol").withColumn("WeekEndingFriday", F.greatest("ReleaseWeek", "_first"))
    order = [F.col("ReleaseWeek"), F.col("acceptedDate"), F.col("filingDate"), F.col("date")]
    ties = [c for c in factors.columns if c not in ("symbol", "ReleaseWeek", "acceptedDate", "filingDate", "date")]
    one = best_per_key(placed.drop("_first"), ["symbol", "WeekEndingFriday"], order, ties)
    grid = bars.select(F.col("Ticker").alias("symbol"), "WeekEndingFriday", "ClosePrice")
    return grid.join(one, ["symbol", "WeekEndingFriday"], "left").withColumn(
        "QuarterlyReleased", as_flag(F.col("ReleaseWeek") == F.col("WeekEndingFriday"))
    )


def fill_and_scale(aligned: DataFrame) -> DataFrame:
    """Forward-filled columns and the weekly market cap, moved with the close since the last report.

    Values are filled each on its own. Flags and quarter lags come from the latest statement as one
    struct: a flag is set on every statement, and a lag counts only where the latest statement has
    it, so for them the latest row is the answer and a missing lag stays missing.
    """
    w = entity_window("symbol", "WeekEndingFriday")
    frame = "partition by symbol order by WeekEndingFriday asc nulls last rows between unbounded preceding and current row"
    latest = f"if(ReleaseWeek is not null, struct({', '.join([*FLAGS, *LAGGED])}), null)"
    out = aligned.withColumns({
        "_cap": forward_fill("marketCap", w), "_anchor": anchored("ClosePrice", "marketCap", w),
    }).selectExpr(
        "symbol", "WeekEndingFriday", "QuarterlyReleased", "ClosePrice", "_cap", "_anchor",
        *[f"last({c}, true) over ({frame}) as {c}" for c in [*CARRIED, *STATEMENT_FEATURES]],
        f"last({latest}, true) over ({frame}) as _latest",
    )
    return out.withColumn("MarketCap", F.col("_cap") * safe_divide("ClosePrice", "_anchor")).select(
        "symbol", "WeekEndingFriday", "QuarterlyReleased", "MarketCap", *CARRIED, *STATEMENT_FEATURES, "_latest.*"
    )


def weekly_features(filled: DataFrame) -> DataFrame:
    """Market ratios, null rules and weekly lags; all weeks."""
    cap = F.col("MarketCap")
    ruled = {
        "BookToMarket": safe_divide("totalStockholdersEquity", cap),
        "FreeCashFlowYield": null_where(safe_divide("freeCashFlow", cap), "FreeCashFlowZeroFlag"),
        "FreeCashFlowYield_TTM": null_where(safe_divide("freeCashFlow_TTM", cap), "FreeCashFlowTTMZeroFlag"),
        "EarningsYield": safe_divide("netIncome", cap),
        "EarningsYield_TTM": safe_divide("netIncome_TTM", cap),
        "InvestmentIntensity": null_where("InvestmentIntensity", "CapexReportedZeroFlag"),
        "DebtToAssets": null_where("DebtToAssets", "SuspiciousTotalDebtZeroFlag"),
    }
    values = filled.withColumns(ruled).select(
        "symbol", "WeekEndingFriday", "QuarterlyReleased", *MARKET_FEATURES, *STATEMENT_FEATURES, *LAGGED
    )
    week = "partition by symbol order by WeekEndingFriday asc nulls last"
    lags = [f"lag({n}, {k}) over ({week}) as {n}_L{k}W" for k in (1, 2) for n in MARKET_FEATURES]
    return values.selectExpr("*", *lags).select("WeekEndingFriday", "symbol", *fundamentals_columns())


def point_in_time_fundamentals(statements: DataFrame, bars: DataFrame, start: str | None = START_DATE) -> DataFrame:
    """Weekly fundamentals of every ticker with prices; the trim comes after lags and fills."""
    out = weekly_features(fill_and_scale(align_to_weeks(statement_factors(statements), bars)))
    return out if start is None else out.filter(F.col("WeekEndingFriday") >= F.lit(start).cast("date"))
