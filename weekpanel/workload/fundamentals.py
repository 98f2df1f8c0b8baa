"""Queries on statements, point-in-time fundamentals and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekpanel.contracts import FLOW_ITEMS, MARKET_FEATURES, STATEMENT_FEATURES, fundamentals_columns
from weekpanel.operators.aggregates import column_profile, entity_profile, moments
from weekpanel.plans.fundamentals import (
    align_to_weeks, fill_and_scale, newest_per_statement, point_in_time_fundamentals, statement_factors, ttm_and_flags,
    weekly_features, with_quarter_lags, with_ratios, with_release_week,
)
from weekpanel.plans.panel import complete_case, merge_panel
from weekpanel.plans.prices import price_features, weekly_bars
from weekpanel.plans.reports import missing_profile, snapshot_diff, snapshot_summary
from weekpanel.plans.statements import merge_statements
from weekpanel.workload.prices import BARS, FRI, PRICE, PRICE_OUT
from weekpanel.workload.registry import query

START = "1999-01-01"

RELEASED = f"""
  select *, {FRI.format('p')} as ReleaseWeek from (
    select *, case when acceptedDate is not null and not coalesce(acceptedDate < date, false) then acceptedDate
                   when filingDate is not null and not coalesce(filingDate < date, false) then filingDate
                   else greatest(date, filingDate, acceptedDate) end as p from f_statements) where p is not null"""

NEWEST = f"""
  select * from (select *, row_number() over (partition by symbol, date order by acceptedDate desc nulls last,
    filingDate desc nulls last, version desc) as rn from ({RELEASED})) where rn = 1"""

_TTM = ", ".join(
    f"case when count({c}) over w4 = 4 then sum({c}) over w4 end as {c}_TTM" for c in FLOW_ITEMS
)
SUMMED = f"""
  select *, case when freeCashFlow_TTM = 0 then 1 else 0 end as FreeCashFlowTTMZeroFlag from (
    select *, {_TTM}, lag(totalAssets, 4) over w as a4,
      case when totalDebt = 0 and lag(totalDebt) over w > 0 and lead(totalDebt) over w > 0 then 1 else 0 end as SuspiciousTotalDebtZeroFlag,
      case when capex = 0 then 1 else 0 end as CapexReportedZeroFlag,
      case when freeCashFlow = 0 then 1 else 0 end as FreeCashFlowZeroFlag
    from (select *, -abs(capitalExpenditure) as capex from ({NEWEST}))
    window w as (partition by symbol order by date),
           w4 as (partition by symbol order by date rows between 3 preceding and current row))"""

_AVG = "nullif(case when totalAssets + a4 > 0 then (totalAssets + a4) / 2 end, 0)"
_RATIO = {
    "GrossProfitability": "grossProfit / nullif(totalAssets, 0)",
    "GrossProfitability_TTM": f"grossProfit_TTM / {_AVG}",
    "OperatingMargin": "operatingIncome / nullif(revenue, 0)",
    "OperatingMargin_TTM": "operatingIncome_TTM / nullif(revenue_TTM, 0)",
    "ROA": "netIncome / nullif(totalAssets, 0)",
    "ROA_TTM": f"netIncome_TTM / {_AVG}",
    "AssetGrowth": "(totalAssets - a4) / nullif(a4, 0)",
    "InvestmentIntensity": "case when CapexReportedZeroFlag = 0 then -capex / nullif(totalAssets, 0) end",
    "Accruals": "(netIncome - operatingCashFlow) / nullif(totalAssets, 0)",
    "Accruals_TTM": "(netIncome_TTM - operatingCashFlow_TTM) / nullif(totalAssets, 0)",
    "DebtToAssets": "case when SuspiciousTotalDebtZeroFlag = 0 then totalDebt / nullif(totalAssets, 0) end",
    "WorkingCapitalScaled": "(totalCurrentAssets - totalCurrentLiabilities) / nullif(totalAssets, 0)",
}
RATIOS = f"select *, {', '.join(f'{e} as {n}' for n, e in _RATIO.items())} from ({SUMMED})"
_LAGGED = [f"{n}_L{k}Q" for n in STATEMENT_FEATURES for k in (1, 2)]
FACTORS = f"""select *, {', '.join(f'case when {c} is null then 1 else 0 end as {c}MissingFlag' for c in _LAGGED)} from (
    select *, {', '.join(f'lag({n}, {k}) over w as {n}_L{k}Q' for n in STATEMENT_FEATURES for k in (1, 2))}
    from ({RATIOS}) window w as (partition by symbol order by date))"""

# One row per release week, then the grid with the seed of the first week.
WEEKLY = f"""
  select * from (select *, row_number() over (partition by symbol, ReleaseWeek order by acceptedDate desc nulls last,
    filingDate desc nulls last, date desc) as rw from ({FACTORS})) where rw = 1"""
ALIGNED = f"""
  with bars as materialized ({BARS}), weekly as materialized ({WEEKLY}),
       first as (select Ticker, min(WeekEndingFriday) as first_week from bars group by Ticker),
       seed as (select weekly.*, first_week from weekly join first on symbol = Ticker where ReleaseWeek < first_week
                qualify row_number() over (partition by symbol order by ReleaseWeek desc) = 1),
       has as (select symbol from weekly join first on symbol = Ticker where ReleaseWeek = first_week),
       source as (select weekly.*, ReleaseWeek as grid_week, 1 as released from weekly union all
                  select * exclude (first_week), first_week, 0 from seed where symbol not in (select symbol from has))
  select b.Ticker as sym, b.WeekEndingFriday, b.ClosePrice, coalesce(released, 0) as QuarterlyReleased, s.*
  from bars b left join source s on s.symbol = b.Ticker and s.grid_week = b.WeekEndingFriday"""

_RAW = ["totalStockholdersEquity", "freeCashFlow", "freeCashFlow_TTM", "netIncome", "netIncome_TTM"]
_FLAGS = ["CapexReportedZeroFlag", "FreeCashFlowZeroFlag", "FreeCashFlowTTMZeroFlag", "SuspiciousTotalDebtZeroFlag"]
_FILL = [*_RAW, *_FLAGS, *STATEMENT_FEATURES, *_LAGGED, *[f"{c}MissingFlag" for c in _LAGGED]]
FILLED = f"""
  select *, cap * (ClosePrice / nullif(anchor, 0)) as MarketCap from (
    select sym as symbol, WeekEndingFriday, QuarterlyReleased, ClosePrice,
      last_value(marketCap ignore nulls) over w as cap,
      last_value(case when marketCap is not null then ClosePrice end ignore nulls) over w as anchor,
      {', '.join(f'last_value({c} ignore nulls) over w as {c}' for c in _FILL)}
    from ({ALIGNED}) window w as (partition by sym order by WeekEndingFriday rows between unbounded preceding and current row))"""

_MARKET = {
    "BookToMarket": "totalStockholdersEquity / nullif(MarketCap, 0)",
    "MarketCap": "MarketCap",
    "FreeCashFlowYield": "case when coalesce(FreeCashFlowZeroFlag, 0) = 0 then freeCashFlow / nullif(MarketCap, 0) end",
    "FreeCashFlowYield_TTM": "case when coalesce(FreeCashFlowTTMZeroFlag, 0) = 0 then freeCashFlow_TTM / nullif(MarketCap, 0) end",
    "EarningsYield": "netIncome / nullif(MarketCap, 0)",
    "EarningsYield_TTM": "netIncome_TTM / nullif(MarketCap, 0)",
}
_STAT = {
    n: {"InvestmentIntensity": "case when coalesce(CapexReportedZeroFlag, 0) = 0 then InvestmentIntensity end",
        "DebtToAssets": "case when coalesce(SuspiciousTotalDebtZeroFlag, 0) = 0 then DebtToAssets end"}.get(n, n)
    for n in STATEMENT_FEATURES
}
FUND = f"""
  select *, {', '.join(f'lag({n}, {k}) over w as {n}_L{k}W' for n in MARKET_FEATURES for k in (1, 2))} from (
    select symbol, WeekEndingFriday, QuarterlyReleased,
      {', '.join(f'{e} as {n}' for n, e in {**_MARKET, **_STAT}.items())},
      {', '.join(f'case when coalesce({c}MissingFlag, 0) = 0 then {c} end as {c}' for c in _LAGGED)}
    from ({FILLED})) window w as (partition by symbol order by WeekEndingFriday)"""

FUND_OUT = "WeekEndingFriday:t symbol:s QuarterlyReleased:l " + " ".join(f"{c}:d" for c in fundamentals_columns()[1:])
_FEATURE_NAMES = fundamentals_columns()
_PRICE_NAMES = [p.rsplit(":", 1)[0] for p in PRICE_OUT.split()]
_PANEL_NAMES = [c for c in _PRICE_NAMES if c not in ("ClosePrice", "ClosePrice_t-1", "ClosePrice_t-2", "ClosePrice_t+1")]
PANEL = f"""
  select {', '.join(f'p."{c}"' for c in _PANEL_NAMES)}, {', '.join(f'f."{c}"' for c in _FEATURE_NAMES)}, c.SectorCode
  from ({PRICE}) p join ({FUND}) f on p.Ticker = f.symbol and p.WeekEndingFriday = f.WeekEndingFriday
  left join f_companies c on c.Ticker = p.Ticker where f.WeekEndingFriday >= date '{START}'"""
_KINDS = {"WeekEndingFriday": "t", "Ticker": "s", "AdjClosePrice_t+1_Up": "l", "QuarterlyReleased": "l", "SectorCode": "l"}
PANEL_COLUMNS = [*_PANEL_NAMES, *_FEATURE_NAMES, "SectorCode"]
PANEL_OUT = " ".join(f"{c}:{_KINDS.get(c, 'd')}" for c in PANEL_COLUMNS)


def panel_of(t, start: str = START):
    """The panel over the fixture views."""
    bars = weekly_bars(t.fixture("daily"))
    fundamentals = point_in_time_fundamentals(t.fixture("statements"), bars, start)
    return merge_panel(price_features(bars), fundamentals, t.fixture("companies"))


@query("public_date_rule", "H17 H16", "symbol:s date:t version:l PublicDate:t ReleaseWeek:t",
       f"select *, p as PublicDate from ({RELEASED})")
def _(t):
    return with_release_week(t.fixture("statements"))


@query("statement_dedup", "S9 G4 D5", "symbol:s date:t version:l netIncome:d", NEWEST)
def _(t):
    return newest_per_statement(with_release_week(t.fixture("statements")))


@query("ttm_sums", "E5 H19 E7 H20", "symbol:s date:t " + " ".join(f"{c}_TTM:d" for c in FLOW_ITEMS)
       + " SuspiciousTotalDebtZeroFlag:l CapexReportedZeroFlag:l FreeCashFlowZeroFlag:l FreeCashFlowTTMZeroFlag:l", SUMMED)
def _(t):
    return ttm_and_flags(newest_per_statement(with_release_week(t.fixture("statements"))))


@query("fundamental_ratios", "H11 E8", "symbol:s date:t " + " ".join(f"{c}:d" for c in STATEMENT_FEATURES), RATIOS)
def _(t):
    return with_ratios(ttm_and_flags(newest_per_statement(with_release_week(t.fixture("statements")))))


@query("quarter_lags", "E10", "symbol:s date:t " + " ".join(f"{c}:d {c}MissingFlag:l" for c in _LAGGED), FACTORS)
def _(t):
    return with_quarter_lags(with_ratios(ttm_and_flags(newest_per_statement(with_release_week(t.fixture("statements"))))))


@query("quarterly_released", "C13 C14", "symbol:s WeekEndingFriday:t QuarterlyReleased:l ReleaseWeek:t",
       f"select sym as symbol, WeekEndingFriday, QuarterlyReleased, ReleaseWeek from ({ALIGNED})")
def _(t):
    return align_to_weeks(statement_factors(t.fixture("statements")), weekly_bars(t.fixture("daily")))


@query("weekly_market_cap", "E11 E12", "symbol:s WeekEndingFriday:t MarketCap:d netIncome_TTM:d ROA:d", FILLED)
def _(t):
    return fill_and_scale(align_to_weeks(statement_factors(t.fixture("statements")), weekly_bars(t.fixture("daily"))))


@query("pit_fundamentals", "P4 C13 C14 E9 E10 E11 E12 H20", FUND_OUT, FUND)
def _(t):
    return point_in_time_fundamentals(t.fixture("statements"), weekly_bars(t.fixture("daily")), None)


@query("panel_merge", "P5 C1 C2 B10", PANEL_OUT, PANEL)
def _(t):
    return panel_of(t)


@query("complete_case", "P6 B6", " ".join(f"{c}:{_KINDS.get(c, 'd')}" for c in PANEL_COLUMNS[2:]),
       f"select * from ({PANEL}) where " + " and ".join(f'"{c}" is not null' for c in PANEL_COLUMNS))
def _(t):
    return complete_case(panel_of(t))


def _count_nulls(columns, joiner):
    return f" {joiner} ".join(f'"{c}" is null' for c in columns)


@query("quality_profile", "P17 D8 D9", "Ticker:s Rows:l MissingValues:l MissingPct:d ZeroValues:l ZeroPct:d",
       f"""select Ticker, n as Rows, m as MissingValues, round(100.0 * m / (n * {len(_FEATURE_NAMES)}), 2) as MissingPct, z as ZeroValues,
                  round(100.0 * z / (n * {len(_FEATURE_NAMES) - 1}), 2) as ZeroPct
           from (select symbol as Ticker, count(*) as n,
                 sum(cast(WeekEndingFriday is null as int) + {' + '.join(f'cast({c} is null as int)' for c in _FEATURE_NAMES[1:])}) as m,
                 sum({' + '.join(f'coalesce(cast({c} = 0 as int), 0)' for c in _FEATURE_NAMES[1:])}) as z
                 from ({FUND}) group by symbol)""")
def _(t):
    f = point_in_time_fundamentals(t.fixture("statements"), weekly_bars(t.fixture("daily")), None)
    return entity_profile(f.withColumnRenamed("symbol", "Ticker"), "Ticker", ["QuarterlyReleased"])


@query("column_profile", "D8 D9", "column:s missing:l zeros:l",
       f"with s as materialized ({SUMMED}) " + " union all ".join(
           f"select '{c}' as \"column\", count(*) filter ({c} is null) as missing, count(*) filter ({c} = 0) as zeros from s"
           for c in ["marketCap", "totalDebt", "freeCashFlow", "revenue_TTM"]))
def _(t):
    rows = ttm_and_flags(newest_per_statement(with_release_week(t.fixture("statements"))))
    return column_profile(rows, ["marketCap", "totalDebt", "freeCashFlow", "revenue_TTM"])


@query("feature_moments", "J5 D15", "column:s mean:d std:d",
       f"with p as materialized ({PRICE}) " + " union all ".join(
           f"select '{c}' as \"column\", avg({c}) as mean, stddev_pop({c}) as std from p"
           for c in ["WeeklyReturn_1W", "Momentum_12W", "Volatility_12W"]))
def _(t):
    return moments(price_features(weekly_bars(t.fixture("daily"))), ["WeeklyReturn_1W", "Momentum_12W", "Volatility_12W"])


@query("merged_statements", "C3 B12", "symbol:s date:t filingDate:t netIncome:d totalDebt:d freeCashFlow:d marketCap:d",
       """with n as (select * from (select *, row_number() over (partition by symbol, date order by acceptedDate desc nulls last,
                     filingDate desc nulls last, version desc) as rn from f_statements) where rn = 1)
          select i.symbol, i.date, i.filingDate, i.netIncome, b.totalDebt, b.freeCashFlow, v.marketCap
          from n i join n b on i.symbol = b.symbol and i.date = b.date
          left join (select * from n where marketCap is not null) v on i.symbol = v.symbol and i.date = v.date
          where b.totalDebt > 0""")
def _(t):
    s = t.fixture("statements")
    key = ["symbol", "date"]
    income = s.select(*key, "filingDate", "acceptedDate", "revenue", "grossProfit", "operatingIncome",
                      F.col("netIncome").alias("bottomLineNetIncome"), "version")
    # the balance side lacks some statements; the market values lack others
    newest = newest_per_statement(s)
    balance = newest.filter("totalDebt > 0").select(*key, "acceptedDate", "totalAssets", "totalDebt", "totalCurrentAssets")
    cash = newest.select(*key, "operatingCashFlow", "capitalExpenditure", "freeCashFlow")
    values = newest.filter("marketCap is not null").select(*key, F.col("marketCap").alias("marketCapitalization"))
    return merge_statements(income, balance, cash, values)


@query("snapshot_diff", "P19 C16", "symbol:s rows_before:l rows_after:l rows_delta:l status:s",
       """select coalesce(b.symbol, a.symbol) as symbol, coalesce(nb, 0) as rows_before, coalesce(na, 0) as rows_after,
                 coalesce(na, 0) - coalesce(nb, 0) as rows_delta,
                 case when coalesce(nb, 0) = 0 then 'added' when coalesce(na, 0) = 0 then 'removed' else 'kept' end as status
          from (select symbol, count(*) as nb from f_caps where cap_date < date '1999-06-01' group by 1) b
          full join (select symbol, count(*) as na from f_caps where cap_date >= date '1999-06-01' group by 1) a on a.symbol = b.symbol""")
def _(t):
    c = t.fixture("caps")
    day = F.lit("1999-06-01").cast("date")
    return snapshot_diff(c.filter(F.col("cap_date") < day), c.filter(F.col("cap_date") >= day), "symbol")


@query("snapshot_summary", "P19 G2", "rows_before:l rows_after:l keys_before:l keys_after:l keys_added:l keys_removed:l",
       """select count(*) filter (early) as rows_before, count(*) filter (not early) as rows_after,
                 count(distinct case when early then symbol end) as keys_before, count(distinct case when not early then symbol end) as keys_after,
                 count(distinct symbol) - count(distinct case when early then symbol end) as keys_added,
                 count(distinct symbol) - count(distinct case when not early then symbol end) as keys_removed
          from (select symbol, cap_date < date '1998-06-01' as early from f_caps)""")
def _(t):
    c = t.fixture("caps")
    day = F.lit("1998-06-01").cast("date")
    return snapshot_summary(c.filter(F.col("cap_date") < day), c.filter(F.col("cap_date") >= day), "symbol")


@query("weekly_feature_lags", "E9", "symbol:s WeekEndingFriday:t MarketCap:d MarketCap_L1W:d MarketCap_L2W:d EarningsYield_L2W:d", FUND)
def _(t):
    return weekly_features(fill_and_scale(align_to_weeks(statement_factors(t.fixture("statements")), weekly_bars(t.fixture("daily")))))


_MP = [c for c in PANEL_COLUMNS]


@query("missing_rows_by_ticker", "P16 D2 D3", "Ticker:s TotalRows:l RowsWithAnyMissing:l PctAnyMissing:d",
       f"""select Ticker, count(*) as TotalRows, count(*) filter ({_count_nulls(_MP, 'or')}) as RowsWithAnyMissing,
                  round(100.0 * count(*) filter ({_count_nulls(_MP, 'or')}) / count(*), 2) as PctAnyMissing
           from ({PANEL}) group by Ticker""")
def _(t):
    return missing_profile(panel_of(t))
