"""Queries on prices: weekly bars, features, charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekpanel.contracts import PRICE_COLUMNS
from weekpanel.functions.dates import week_ending_friday
from weekpanel.functions.windows import difference, entity_window, moving_average, pct_change, running_total, zscore
from weekpanel.operators.aggregates import correlation_pairs, exact_quantiles, histogram
from weekpanel.plans.prices import price_features, price_features_all, weekly_bars
from weekpanel.plans.reports import company_frames, company_summary, correlation_report, daily_activity, target_correlations
from weekpanel.workload.registry import query

FRI = "cast({0} + to_days(cast((12 - dayofweek({0})) % 7 as int)) as date)"

BARS = f"""
  select Ticker, week as WeekEndingFriday, arg_max(ClosePrice, ActualTradingDate) as ClosePrice,
         arg_max(AdjClosePrice, ActualTradingDate) as AdjClosePrice
  from (select *, {FRI.format('ActualTradingDate')} as week from f_daily) group by Ticker, week"""

_KIND = {"WeekEndingFriday": "t", "Ticker": "s", "AdjClosePrice_t+1_Up": "l"}
PRICE_OUT = " ".join(f"{c}:{_KIND.get(c, 'd')}" for c in PRICE_COLUMNS)

PRICE_ALL = f"""
  select *, case when "AdjClosePrice_t+1" > AdjClosePrice then 1 else 0 end as "AdjClosePrice_t+1_Up",
         case when count(WeeklyReturn_1W) over f4 = 4 then stddev_samp(WeeklyReturn_1W) over f4 end as Volatility_4W,
         case when count(WeeklyReturn_1W) over f12 = 12 then stddev_samp(WeeklyReturn_1W) over f12 end as Volatility_12W
  from (
    select *, lag(ClosePrice, 1) over w as "ClosePrice_t-1", lag(ClosePrice, 2) over w as "ClosePrice_t-2",
           lead(ClosePrice, 1) over w as "ClosePrice_t+1", lag(AdjClosePrice, 1) over w as "AdjClosePrice_t-1",
           lag(AdjClosePrice, 2) over w as "AdjClosePrice_t-2", lead(AdjClosePrice, 1) over w as "AdjClosePrice_t+1",
           AdjClosePrice / nullif(lag(AdjClosePrice, 1) over w, 0) - 1 as WeeklyReturn_1W,
           AdjClosePrice / nullif(lag(AdjClosePrice, 4) over w, 0) - 1 as WeeklyReturn_4W,
           AdjClosePrice / nullif(lag(AdjClosePrice, 12) over w, 0) - 1 as Momentum_12W,
           case when count(AdjClosePrice) over m12 = 12
                then AdjClosePrice / nullif(max(AdjClosePrice) over m12, 0) - 1 end as Drawdown_12W
    from ({BARS})
    window w as (partition by Ticker order by WeekEndingFriday),
           m12 as (partition by Ticker order by WeekEndingFriday rows between 11 preceding and current row))
  window f4 as (partition by Ticker order by WeekEndingFriday rows between 3 preceding and current row),
         f12 as (partition by Ticker order by WeekEndingFriday rows between 11 preceding and current row)"""
PRICE = (
    f'select * from ({PRICE_ALL}) where "ClosePrice_t+1" is not null and "AdjClosePrice_t+1" is not null '
    "and Volatility_12W is not null and Momentum_12W is not null and Drawdown_12W is not null"
)


@query("weekly_bars", "H14 E21 P2", "Ticker:s WeekEndingFriday:t ClosePrice:d AdjClosePrice:d", BARS)
def _(t):
    return weekly_bars(t.fixture("daily"))


@query("price_features", "E1 E2 E3 E4 H24 B6 P3", PRICE_OUT, PRICE)
def _(t):
    return price_features(weekly_bars(t.fixture("daily")))


@query("drawdown_top_weeks", "E4 F2", "Ticker:s WeekEndingFriday:t Drawdown_12W:d",
       f"select * from ({PRICE_ALL}) where Drawdown_12W is not null "
       "order by Drawdown_12W, Ticker, WeekEndingFriday limit 20")
def _(t):
    p = price_features_all(weekly_bars(t.fixture("daily"))).filter("Drawdown_12W is not null")
    return p.orderBy("Drawdown_12W", "Ticker", "WeekEndingFriday").limit(20)


@query("moving_average_6w", "E6", "Ticker:s WeekEndingFriday:t MA_6W:d",
       f"select *, avg(AdjClosePrice) over (partition by Ticker order by WeekEndingFriday "
       f"rows between 5 preceding and current row) as MA_6W from ({BARS})")
def _(t):
    w = entity_window("Ticker", "WeekEndingFriday")
    return weekly_bars(t.fixture("daily")).withColumn("MA_6W", moving_average("AdjClosePrice", 6, w))


@query("weekly_difference", "E16", "Ticker:s WeekEndingFriday:t change:d",
       f"select * from (select *, AdjClosePrice - lag(AdjClosePrice) over (partition by Ticker order by WeekEndingFriday) "
       f"as change from ({BARS})) where change is not null")
def _(t):
    w = entity_window("Ticker", "WeekEndingFriday")
    return weekly_bars(t.fixture("daily")).withColumn("change", difference("AdjClosePrice", w)).na.drop(subset=["change"])


@query("return_zscore", "E15 D15 L4", "Ticker:s WeekEndingFriday:t z:d",
       f"""select Ticker, WeekEndingFriday, case when r is null then null
             when coalesce(stddev_samp(r) over g, 0) = 0 then 0.0 else (r - avg(r) over g) / stddev_samp(r) over g end as z
           from (select *, AdjClosePrice / nullif(lag(AdjClosePrice) over (partition by Ticker order by WeekEndingFriday), 0) - 1 as r
                 from ({BARS})) window g as (partition by Ticker)""")
def _(t):
    w = entity_window("Ticker", "WeekEndingFriday")
    r = weekly_bars(t.fixture("daily")).withColumn("r", pct_change("AdjClosePrice", 1, w))
    return r.withColumn("z", zscore("r", "Ticker"))


@query("return_histogram", "D14", "bin:l left_edge:d right_edge:d n:l",
       f"""with r as (select AdjClosePrice / nullif(lag(AdjClosePrice) over (partition by Ticker order by WeekEndingFriday), 0) - 1 as v
                      from ({BARS})),
             b as (select min(v) as lo, (max(v) - min(v)) / 16 as w from r)
           select g.bin, lo + g.bin * w as left_edge, lo + (g.bin + 1) * w as right_edge, count(v) as n
           from b cross join (select unnest(range(16)) as bin) g
           left join r on least(floor((v - lo) / w), 15) = g.bin group by g.bin, lo, w""")
def _(t):
    w = entity_window("Ticker", "WeekEndingFriday")
    return histogram(weekly_bars(t.fixture("daily")).select(pct_change("AdjClosePrice", 1, w).alias("v")), "v", 16)


@query("company_frames", "P20 F7 I4 E6", "Ticker:s WeekEndingFriday:t DisplayPrice:d WeeklyReturn:d NewsCount:l MA_6W:d",
       f"""with p as (select Ticker, WeekEndingFriday, AdjClosePrice as DisplayPrice,
              AdjClosePrice / nullif(lag(AdjClosePrice) over w, 0) - 1 as WeeklyReturn,
              row_number() over (partition by Ticker order by WeekEndingFriday desc) as rn
              from ({BARS}) window w as (partition by Ticker order by WeekEndingFriday)),
            n as (select Ticker, {FRI.format('cast(Date as date)')} as week, count(*) as c from f_articles group by 1, 2)
          select p.*, coalesce(c, 0) as NewsCount, avg(DisplayPrice) over (partition by p.Ticker order by WeekEndingFriday
                 rows between 5 preceding and current row) as MA_6W
          from p left join n on p.Ticker = n.Ticker and p.WeekEndingFriday = n.week
          where rn <= 120 and WeekEndingFriday >= date '1998-01-01'""")
def _(t):
    return company_frames(weekly_bars(t.fixture("daily")), t.fixture("articles"), 120, "1998-01-01")


@query("company_summary", "D16 P20", "Ticker:s RecentPrice:d CumulativeReturn:d MeanWeeklyReturn:d TotalNews:l",
       f"""with p as (select Ticker, WeekEndingFriday, AdjClosePrice as x,
              AdjClosePrice / nullif(lag(AdjClosePrice) over (partition by Ticker order by WeekEndingFriday), 0) - 1 as r from ({BARS})),
            n as (select Ticker, {FRI.format('cast(Date as date)')} as week, count(*) as c from f_articles group by 1, 2)
          select p.Ticker, arg_max(x, WeekEndingFriday) as RecentPrice,
                 arg_max(x, WeekEndingFriday) / arg_min(x, WeekEndingFriday) - 1 as CumulativeReturn,
                 avg(r) as MeanWeeklyReturn, sum(coalesce(c, 0)) as TotalNews
          from p left join n on p.Ticker = n.Ticker and p.WeekEndingFriday = n.week
          where WeekEndingFriday >= date '1998-06-01' group by p.Ticker""")
def _(t):
    return company_summary(company_frames(weekly_bars(t.fixture("daily")), t.fixture("articles"), 0, "1998-06-01"))


@query("daily_activity", "P21 I4 E17", "day:t n:l running_total:l",
       """with c as (select cast(ts as date) as day, count(*) as n from events group by 1),
            d as (select unnest(generate_series((select min(day) from c), (select max(day) from c), interval 1 day))::date as day)
          select d.day, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (order by d.day) as running_total
          from d left join c on d.day = c.day""")
def _(t):
    return daily_activity(t.raw("events"), "ts")


@query("article_calendar", "I4 E17", "Ticker:s day:t n:l running:l",
       """with c as (select Ticker, cast(Date as date) as day, count(*) as n from f_articles group by 1, 2),
            b as (select Ticker, min(day) as lo, max(day) as hi from c group by 1),
            d as (select Ticker, unnest(generate_series(lo, hi, interval 1 day))::date as day from b)
          select d.Ticker, d.day, coalesce(n, 0) as n,
                 sum(coalesce(n, 0)) over (partition by d.Ticker order by d.day) as running
          from d left join c on d.Ticker = c.Ticker and d.day = c.day""")
def _(t):
    from weekpanel.operators.reshape import fill_calendar

    c = t.fixture("articles").groupBy("Ticker", F.col("Date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    full = fill_calendar(c, "day", ["n"], ["Ticker"])
    return full.withColumn("running", running_total("n", entity_window("Ticker", "day")))


_ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_pairs", "D12 I3 P18", "a:s b:s r:d",
       " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem"
                          for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1:]))
def _(t):
    return correlation_pairs(t.raw("lineitem"), _ITEMS)


@query("correlation_pairs_blocked", "D12", "a:s b:s r:d",
       " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem"
                          for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1:]))
def _(t):
    return correlation_pairs(t.raw("lineitem"), _ITEMS, native_pairs=0)


_FEATURES = ["WeeklyReturn_1W", "WeeklyReturn_4W", "Momentum_12W", "Volatility_4W", "Volatility_12W", "Drawdown_12W"]


@query("correlation_report", "I3 P18", "a:s b:s r:d",
       f"with p as materialized ({PRICE}) select * from (" + " union all ".join(
           f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from p" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1:]
       ) + ") where abs(r) >= 0.2")
def _(t):
    return correlation_report(price_features(weekly_bars(t.fixture("daily"))), 0.2, _FEATURES)


@query("target_correlations", "F6 P18", "feature:s r:d",
       f"with p as materialized ({PRICE}) select * from (" + " union all ".join(
           f"""select '{a}' as feature, corr({a}, "AdjClosePrice_t+1") as r from p""" for a in _FEATURES
       ) + ") order by abs(r) desc, feature limit 4")
def _(t):
    return target_correlations(price_features(weekly_bars(t.fixture("daily"))), "AdjClosePrice_t+1", 4, _FEATURES)


@query("price_quantiles", "D13", "l_returnflag:s q0:d q1:d q2:d",
       """select l_returnflag, quantile_cont(l_extendedprice, 0.25) as q0, quantile_cont(l_extendedprice, 0.5) as q1,
                 quantile_cont(l_extendedprice, 0.75) as q2 from lineitem group by l_returnflag""")
def _(t):
    return exact_quantiles(t.raw("lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.75])


@query("weekly_volume", "H14 D2", "WeekEndingFriday:t n:l",
       f"select {FRI.format('cast(l_shipdate as date)')} as WeekEndingFriday, count(*) as n from lineitem group by 1")
def _(t):
    week = week_ending_friday(F.col("l_shipdate").cast("date")).alias("WeekEndingFriday")
    return t.raw("lineitem").groupBy(week).agg(F.count(F.lit(1)).alias("n"))
