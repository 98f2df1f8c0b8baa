"""Queries on landed files through their readers, refreshed tables, counts on the way, and the whole choice of companies."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from weekpanel.operators.joins import foreign_key
from weekpanel.operators.rows import filter_date_range
from weekpanel.plans.refresh import refresh_prices, stored_features
from weekpanel.plans.universe import select_universe
from weekpanel.session import freeze, shared_dir
from weekpanel.sources.files import read_api_json, read_entity_files, read_model_results, read_news_json
from weekpanel.sources.upsert import fresh_path
from weekpanel.sources.versions import move
from weekpanel.workload.prices import PRICE, PRICE_OUT
from weekpanel.workload.registry import query
from weekpanel.workload.universe import EXCLUDED, REF


def _landed(t, df, name: str, target, header: bool = False) -> str:
    """One file for each value of ``name``, under the path that ``target`` gives it, as a download leaves them."""
    base = fresh_path(shared_dir(t.spark))
    df = freeze(df.repartition(name))
    writer = df.write.partitionBy(name)
    writer.csv(f"{base}/parts", header=True, escape='"') if header else writer.text(f"{base}/parts")
    for r in df.select(name).distinct().collect():  # a file for each nation or region
        move(t.spark, f"{base}/parts/{name}={r[0]}/part-*", f"{base}/landed/{target(r[0])}")
    return f"{base}/landed"


@query("prices_from_entity_files", "A3", "Ticker:s n:l first:t last:t low:d high:d",
       """select Ticker, count(*) as n, min(ActualTradingDate) as first, max(ActualTradingDate) as last, min(ClosePrice) as low, max(ClosePrice) as high
          from f_daily group by 1""")
def _(t):
    daily = t.fixture("daily").select(F.col("Ticker").alias("name"), "ActualTradingDate", "ClosePrice")
    folder = _landed(t, daily, "name", lambda n: f"{n}_daily_prices.csv", header=True)
    back = read_entity_files(t.spark, folder, "_daily_prices.csv", "ActualTradingDate date, ClosePrice double")
    return back.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"), F.min("ActualTradingDate").alias("first"), F.max("ActualTradingDate").alias("last"),
                                      F.min("ClosePrice").alias("low"), F.max("ClosePrice").alias("high"))


@query("statements_from_api_json", "A4", "symbol:s date:t revenue:d n:l", "select symbol, dt as date, mx as revenue, n from f_quarters")
def _(t):
    """Half of the symbols as lists of rows, half as one object with its history."""
    q = t.fixture("quarters").select("k", "symbol", F.col("dt").alias("date"), F.col("mx").alias("revenue"), "n")
    row = F.struct(F.col("date").cast("string").alias("date"), "revenue", "n")
    nested = q.filter("k % 2 = 0").groupBy(F.col("symbol").alias("name")).agg(F.to_json(F.struct(F.first("symbol").alias("symbol"), F.collect_list(row).alias("historical"))).alias("value"))
    flat = q.filter("k % 2 = 1").groupBy(F.col("symbol").alias("name")).agg(F.to_json(F.collect_list(F.struct("symbol", row.getField("date").alias("date"), "revenue", "n"))).alias("value"))
    folder = _landed(t, nested.unionByName(flat), "name", lambda n: f"{n}.json")
    return read_api_json(t.spark, folder, "date date, revenue double, n bigint")


@query("articles_from_news_json", "A5", "Ticker:s ID:s Date:s Headline:s Summary:s n:l",
       """select Ticker, coalesce(ID, '') as ID, strftime(date_trunc('second', Date), '%Y-%m-%d %H:%M:%S') as Date, Headline, Summary, count(*) as n
          from f_articles group by 1, 2, 3, 4, 5""")
def _(t):
    a = t.fixture("articles")
    when = F.concat(F.date_format("Date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    item = F.struct(F.col("ID").alias("id"), when.alias("created_at"), F.col("Headline").alias("headline"), F.col("Summary").alias("summary"))
    files = a.groupBy(F.col("Ticker").alias("name")).agg(F.to_json(F.struct(F.collect_list(item).alias("news"))).alias("value"))
    back = read_news_json(t.spark, _landed(t, files, "name", lambda n: f"{n}.json"))
    return back.withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss")).groupBy("Ticker", "ID", "Date", "Headline", "Summary").agg(F.count(F.lit(1)).alias("n"))


@query("results_from_ranking_files", "A6 J15", "sector:s metric:s position:l model:s test_accuracy:d",
       """select sector, 'accuracy' as metric, row_number() over (partition by sector order by test_accuracy desc, execution_order) as position, model, test_accuracy
          from f_results""")
def _(t):
    r = t.fixture("results")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("test_accuracy")).alias("a"), "execution_order", "model", "test_accuracy")))
    ranking = F.transform(ranked, lambda x: F.struct(x["model"].alias("model"), x["test_accuracy"].alias("test_accuracy")))
    files = r.groupBy(F.col("sector").alias("name")).agg(F.to_json(F.struct(F.lit("accuracy").alias("metric"), ranking.alias("ranking"))).alias("value"))
    return read_model_results(t.spark, _landed(t, files, "name", lambda n: f"{len(n)}.{n}/summary/ranking.json") + "/*/*/*.json")


@query("price_refresh", "P2 P3 A8 G6", PRICE_OUT, PRICE)
def _(t):
    """Three loads: up to the middle of a week, then some tickers further than others, then the rest; each computes open weeks only."""
    store = fresh_path(shared_dir(t.spark))
    daily = freeze(t.fixture("daily"))
    day, late = F.col("ActualTradingDate"), F.endswith("Ticker", F.lit("3"))
    first = day < F.lit("1999-06-23").cast("date")
    second = ~first & ~late & (day < F.lit("2000-03-29").cast("date"))
    refresh_prices(store, daily.filter(first))
    refresh_prices(store, daily.filter(second))
    refresh_prices(store, daily.filter(~first & ~second))
    return stored_features(t.spark, store)


@query("rows_seen_and_dropped", "B3 C9", "step:s rows_in:l rows_dropped:l",
       """select 'dates' as step, count(*) as rows_in, count(*) filter (not (Date >= timestamp '2000-01-01' and Date < timestamp '2001-01-01')) as rows_dropped from f_articles
          union all select 'companies', count(*), count(*) filter (Ticker not in (select Ticker from f_companies where SectorCode > 1))
          from f_articles where Date >= timestamp '2000-01-01' and Date < timestamp '2001-01-01'""")
def _(t):
    """One job filters, looks up keys and counts what both drop."""
    dates, keys = Observation(), Observation()
    inside = filter_date_range(t.fixture("articles"), "Date", "2000-01-01", "2001-01-01", dates)
    ids = t.fixture("companies").filter("SectorCode > 1").select("Ticker", F.col("SectorCode").alias("id_company"))
    foreign_key(inside, ids, {"Ticker": "Ticker"}, "id_company", lost=keys).write.parquet(fresh_path(shared_dir(t.spark)))
    d, k = dates.get, keys.get
    return t.spark.createDataFrame([("dates", d["kept"] + d["dropped"], d["dropped"]), ("companies", k["rows_in"], k["rows_unmatched"] + k["rows_ambiguous"])],
                                   "step string, rows_in long, rows_dropped long")


_WINDOW = ("1997-06-01", "1998-05-31")
_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5, "DELISTED": 9}


@query("universe_in_one_call", "P1 C12 B9 B13", "Ticker:s companyName:s sector:s SectorCode:l marketCap:d historicalMarketCapDate:t universeSource:s",
       f"""with act as (select * from (select symbol, companyName, sector, row_number() over (partition by sector order by marketCap desc, symbol) as r from f_candidates) where r <= 100),
            dl as (select symbol, companyName, 'DELISTED' as sector from f_lifetimes where ipoDate <= date '{REF}' and delistedDate >= date '{REF}' and exchange in ('NYSE', 'NASDAQ')),
            u as (select symbol, companyName, sector, 'active_screener' as src from act union all
                  select symbol, companyName, sector, 'delisted' from dl where symbol not in (select symbol from act)),
            a as (select symbol, coalesce(arg_min(marketCap, cap_date) filter (cap_date >= date '{REF}'), arg_max(marketCap, cap_date) filter (cap_date < date '{REF}')) as marketCap,
                    coalesce(min(cap_date) filter (cap_date >= date '{REF}'), max(cap_date) filter (cap_date < date '{REF}')) as cap_date
                  from f_caps where cap_date between date '{_WINDOW[0]}' and date '{_WINDOW[1]}' group by 1),
            n as (select u.*, a.marketCap, a.cap_date, row_number() over (partition by companyName order by a.marketCap desc, symbol desc) as rc from u join a using (symbol)
                  where symbol not in ('C10', 'C20', 'C30'))
          select symbol as Ticker, companyName, sector, case sector {' '.join(f"when '{k}' then {v}" for k, v in _CODES.items())} end as SectorCode, marketCap,
                 cap_date as historicalMarketCapDate, src as universeSource
          from (select *, row_number() over (partition by sector order by marketCap desc, symbol) as rs from n where rc = 1) where rs <= 10""")
def _(t):
    gone = t.fixture("lifetimes").withColumns({"sector": F.lit("DELISTED"), "universeSource": F.lit("delisted")})
    caps = t.fixture("caps").withColumnRenamed("cap_date", "date")
    return select_universe(t.fixture("candidates"), gone, caps, REF, 10, EXCLUDED, _CODES, _WINDOW)
