"""Queries on the star schema, the saved views, stored tables and the streaming jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.numeric import as_flag
from weekpanel.operators.joins import count_compare, first_match, unmatched
from weekpanel.operators.ranking import global_position
from weekpanel.operators.reshape import calendar
from weekpanel.operators.rows import filter_from
from weekpanel.plans import star as S
from weekpanel.plans.evaluation import check_summary
from weekpanel.plans.news import clean_news
from weekpanel.plans.prices import price_features, weekly_bars
from weekpanel.plans.scoring import analysis_text, distinct_texts, lexicon_scores
from weekpanel.session import freeze, shared_dir
from weekpanel.sources.files import column_catalog, read_table, write_by_entity, write_table
from weekpanel.sources.upsert import fresh_path, latest_per_key, refresh_partitions
from weekpanel.sources.versions import current
from weekpanel.streaming.jobs import (
    compact, keyed_state, latest_counts, stream_dedup_news, stream_score_new_texts, stream_upsert, stream_weekly_counts, write_batches,
)
from weekpanel.workload.news import GRANGER, weekly_of
from weekpanel.workload.fundamentals import FUND, MARKET_FEATURES, START
from weekpanel.plans.fundamentals import point_in_time_fundamentals
from weekpanel.plans.weekly_news import coefficients_wide, granger_weekly_score
from weekpanel.workload.prices import BARS, FRI, PRICE
from weekpanel.workload.registry import query

FIRST_DAY, LAST_DAY = "1995-01-01", "2004-12-31"


def dims_of(t):
    return S.dimensions(t.fixture("companies"), t.fixture("best"), FIRST_DAY, LAST_DAY)


def predictions_of(t, prices=None):
    """A label, a guess and a probability for every complete price week."""
    p = prices if prices is not None else price_features(weekly_bars(t.fixture("daily")))
    c = t.fixture("companies").select("Ticker", "sector").join(t.fixture("best").select("sector", "best_model"), "sector")
    guess = as_flag(F.col("Momentum_12W") > 0)
    sure = 0.5 + F.col("Volatility_4W") / (2.0 * (1.0 + F.col("Volatility_4W")))
    return p.join(c, "Ticker").select(
        "Ticker", "WeekEndingFriday", "sector", "best_model", F.col("`AdjClosePrice_t+1_Up`").alias("label"),
        guess.alias("predicted"), sure.alias("predicted_probability"),
    )


PRED = f"""
  select p.Ticker, WeekEndingFriday, c.sector, best_model, "AdjClosePrice_t+1_Up" as label, case when Momentum_12W > 0 then 1 else 0 end as predicted,
         0.5 + Volatility_4W / (2.0e0 * (1.0e0 + Volatility_4W)) as predicted_probability
  from ({PRICE}) p join f_companies c on p.Ticker = c.Ticker join f_best b on c.sector = b.sector"""
_SECTORS = "(select row_number() over (order by sector) as id_settore, sector, SectorCode from (select distinct sector, SectorCode from f_companies))"
_INDUSTRIES = "(select row_number() over (order by industry) as id_industry, industry from (select distinct industry from f_companies))"
_FIRMS = f"""(select row_number() over (order by Ticker) as id_azienda, Ticker, companyName, id_settore, id_industry from f_companies
             join {_SECTORS} s using (sector) join {_INDUSTRIES} i using (industry))"""
_MODELS = "(select row_number() over (order by sector, best_model) as id_best_model, * from f_best)"
_DAY = "date_diff('day', date '1995-01-01', {0}) + 1"


@query("dimension_companies", "M1 E20 C9", "id_azienda:l Ticker:s companyName:s id_settore:l id_industry:l", f"select * from {_FIRMS}")
def _(t):
    return dims_of(t)["aziende"]


@query("dimension_sectors", "M1 E20", "id_settore:l sector:s SectorCode:l", f"select * from {_SECTORS}")
def _(t):
    return dims_of(t)["settori"]


@query("dimension_models", "M1 E20", "id_best_model:l sector:s best_model:s test_accuracy:d", f"select * from {_MODELS}")
def _(t):
    return dims_of(t)["modelli"]


@query("dimension_calendar", "M1 I5", "id_calendario:l date:t n:l",
       """with b as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders),
               c as (select unnest(generate_series(date '1995-01-01', date '2004-12-31', interval 1 day))::date as date)
          select date_diff('day', date '1995-01-01', date) + 1 as id_calendario, date, count(o_orderkey) as n from c
          left join orders on cast(o_orderdate as date) = date group by 1, 2""")
def _(t):
    counts = t.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return calendar(t.spark, FIRST_DAY, LAST_DAY).join(counts, "date", "left").na.fill(0, subset=["n"])


@query("fact_market", "M2 E20 C9", "id_mercato:l id_azienda:l id_calendario:l AdjClosePrice:d WeeklyReturn_1W:d",
       f"""select row_number() over (order by p.Ticker, WeekEndingFriday) as id_mercato, id_azienda, {_DAY.format('WeekEndingFriday')} as id_calendario,
                  AdjClosePrice, WeeklyReturn_1W from ({PRICE}) p join {_FIRMS} a on a.Ticker = p.Ticker""")
def _(t):
    return S.fact_market(price_features(weekly_bars(t.fixture("daily"))), dims_of(t))


@query("fact_articles", "M2 E20", "id_articoli:l id_azienda:l id_calendario:l Headline:s",
       f"""select row_number() over (order by n.Ticker, Date, ID nulls first, Headline, Summary) as id_articoli, id_azienda,
                  {_DAY.format('cast(Date as date)')} as id_calendario, Headline from f_articles n join {_FIRMS} a on a.Ticker = n.Ticker""")
def _(t):
    news = t.fixture("articles").select("ID", "Ticker", "Date", "Headline", "Summary")
    return S.fact_articles(news, dims_of(t))


@query("fact_results", "M2 C9 C10 E20", "id_risultati:l id_azienda:l id_calendario:l id_best_model:l AdjClosePrice_t+1:l predicted_AdjClosePrice_t+1:l predicted_probability:d",
       f"""select row_number() over (order by p.sector, p.Ticker, WeekEndingFriday) as id_risultati, id_azienda, {_DAY.format('WeekEndingFriday')} as id_calendario,
                  id_best_model, 2 - label as "AdjClosePrice_t+1", 2 - predicted as "predicted_AdjClosePrice_t+1", predicted_probability
           from ({PRED}) p join {_FIRMS} a on a.Ticker = p.Ticker join {_MODELS} m on m.sector = p.sector and m.best_model = p.best_model""")
def _(t):
    return S.fact_results(predictions_of(t), dims_of(t))


_SCORES = f"(select Ticker, WeekEndingFriday, NEWS_FINBERT_Granger_Score, NEWS_Sentiment_Mean from ({GRANGER}))"


@query("fact_indicators", "M2 C8 E20", "id_indicatori:l id_azienda:l id_calendario:l ROA:d MarketCap:d NEWS_Sentiment_Mean:d",
       f"""select row_number() over (order by symbol, f.WeekEndingFriday) as id_indicatori, id_azienda, {_DAY.format('f.WeekEndingFriday')} as id_calendario,
                  ROA, MarketCap, NEWS_Sentiment_Mean from ({FUND}) f join {_FIRMS} a on a.Ticker = f.symbol
           left join {_SCORES} s on s.Ticker = f.symbol and s.WeekEndingFriday = f.WeekEndingFriday""")
def _(t):
    _, f, scores = _stages(t)
    return S.fact_indicators(f, scores, dims_of(t))


def _stages(t):
    """Price features, fundamentals and news scores; each stage is stored once and read by the next."""
    bars = freeze(weekly_bars(t.fixture("daily")))
    prices = price_features(bars)
    f = freeze(point_in_time_fundamentals(t.fixture("statements"), bars, None))
    keys = prices.select("Ticker", "WeekEndingFriday").join(
        filter_from(f, "WeekEndingFriday", START).select(F.col("symbol").alias("Ticker"), "WeekEndingFriday"), ["Ticker", "WeekEndingFriday"]
    )
    return prices, f, granger_weekly_score(weekly_of(t), keys)


def _tables(t):
    """The tables of the views; a view reads ids of dimensions only, so the facts need no numbers of their own."""
    dims = {n: freeze(df) for n, df in dims_of(t).items()}
    prices, f, scores = _stages(t)
    scored = first_match(f.select("symbol", "WeekEndingFriday"), scores.withColumnRenamed("Ticker", "symbol"), ["symbol", "WeekEndingFriday"], [], S.SCORES)
    return {**dims, "risultati": S.result_links(predictions_of(t, prices), dims), "indicatori": S.indicator_links(scored, dims)}


_BETAS = [f"{b}_lag_{k}" for b in ("beta_negative", "beta_neutral", "beta_positive") for k in (1, 2, 3)]


@query("fact_granger", "M2 I1 C9 E20", "id_granger:l id_azienda:l " + " ".join(f"{b}:d" for b in _BETAS),
       "select row_number() over (order by g.Ticker) as id_granger, id_azienda, " + ", ".join(_BETAS) + " from (select Ticker, "
       + ", ".join(f"max({b[:-6]}) filter (lag = {b[-1]}) as {b}" for b in _BETAS) + f" from f_coeff group by Ticker) g join {_FIRMS} a on a.Ticker = g.Ticker")
def _(t):
    return S.fact_granger(coefficients_wide(t.fixture("coeff")), dims_of(t))


def _star(t, store, stages, tickers, before):
    """One load of the whole star: the given companies, and facts before a day. ``stages`` are stored, since a load reads each several times."""
    early = lambda df, day: df.join(tickers, "Ticker", "left_semi").filter(F.col(day) < F.lit(before).cast("date"))
    prices, f, scores = stages
    f = f.select("symbol", "WeekEndingFriday", "ROA").withColumnRenamed("symbol", "Ticker")
    return S.star_schema(
        store, t.fixture("companies").join(tickers, "Ticker", "left_semi"), t.fixture("best"),
        early(prices.select("Ticker", "WeekEndingFriday", "AdjClosePrice"), "WeekEndingFriday"),
        early(t.fixture("articles").select("ID", "Ticker", "Date", "Headline", "Summary"), "Date"),
        early(f, "WeekEndingFriday").withColumnRenamed("Ticker", "symbol"), scores, early(predictions_of(t, prices), "WeekEndingFriday"),
        coefficients_wide(t.fixture("coeff")).join(tickers, "Ticker", "left_semi"), FIRST_DAY, LAST_DAY)


_RELOAD = {
    "mercato": (f"select Ticker, WeekEndingFriday as d from ({PRICE})", "d"), "articoli": ("select Ticker, Date as d from f_articles", "d"),
    "indicatori": (f"select symbol as Ticker, WeekEndingFriday as d from ({FUND})", "d"), "risultati": (f"select Ticker, WeekEndingFriday as d from ({PRED})", "d"),
    "granger": ("select distinct Ticker, date '1995-01-01' as d from f_coeff", "d"), "aziende": ("select Ticker, date '1995-01-01' as d from f_companies", "d"),
}


@query("star_second_load", "P22 M1 M2 E20", "tabella:s n_first:l n_second:l ids_changed:l ids_behind:l",
       " union all ".join(
           f"""select '{name}' as tabella, count(*) filter (f) as n_first, count(*) as n_second, 0 as ids_changed, count(*) filter (not f) as ids_behind
               from (select Ticker < 'NATION_2' and {d} < date '2000-01-01' as f from ({sql}) x)""" for name, (sql, d) in _RELOAD.items()))
def _(t):
    """Half of the companies and years at first, then all of them: known keys keep their ids, new ones are numbered behind."""
    store = fresh_path(shared_dir(t.spark))
    companies = t.fixture("companies").select("Ticker")
    prices, f, scores = _stages(t)
    stages = freeze(prices), f, freeze(scores)
    _star(t, store, stages, companies.filter("Ticker < 'NATION_2'"), "2000-01-01")
    before = {n: freeze(current(t.spark, f"{store}/keys/{n}")) for n in _RELOAD}
    second = _star(t, store, stages, companies, "2100-01-01")
    out = None
    for name in _RELOAD:
        key = (S.DIMENSION_KEYS | S.FACT_KEYS)[name][0]
        old, new = before[name], current(t.spark, f"{store}/keys/{name}").select("key", "copy", F.col(key).alias("id"))
        moved = old.join(new, ["key", "copy"], "left").filter(~F.col("id").eqNullSafe(F.col(key))).agg(F.count("*")).scalar()
        one = second[name].agg(
            F.count("*").alias("n_second"), F.count_if(F.col(key) > old.agg(F.max(key)).scalar()).alias("ids_behind"),
        ).select(F.lit(name).alias("tabella"), old.agg(F.count("*")).scalar().alias("n_first"), "n_second", moved.alias("ids_changed"), "ids_behind")
        out = one if out is None else out.unionByName(one)
    return out


_VIEW_OUT = ("companyName:s Ticker:s sector:s date:t actual_value:s predicted_value:s predicted_probability:d best_model:s test_accuracy:d "
             "delta_null_model:d delta_always_one:d delta_always_zero:d NEWS_FINBERT_Granger_Score:d NEWS_Sentiment_Mean:d")
_VIEW = f"""
  select c.companyName, p.Ticker, p.sector, p.WeekEndingFriday as date, case label when 1 then 'Up' else 'Down' end as actual_value,
         case predicted when 1 then 'Up' else 'Down' end as predicted_value, predicted_probability, p.best_model, test_accuracy, delta_null_model,
         delta_always_one, delta_always_zero, NEWS_FINBERT_Granger_Score, NEWS_Sentiment_Mean
  from ({PRED}) p join f_companies c on c.Ticker = p.Ticker join f_best b on b.sector = p.sector
  left join {_SCORES} s on s.Ticker = p.Ticker and s.WeekEndingFriday = p.WeekEndingFriday"""


@query("star_top_down", "M3 C11 F2 P22", _VIEW_OUT,
       f"{_VIEW} where predicted = 0 order by predicted_probability desc, p.Ticker, date limit 10")
def _(t):
    return S.most_confident(t.spark, _tables(t), 0)


@query("star_top_up", "M4 C11 F2 P22", _VIEW_OUT,
       f"{_VIEW} where predicted = 1 order by predicted_probability desc, p.Ticker, date limit 10")
def _(t):
    return S.most_confident(t.spark, _tables(t), 1)


@query("star_uncertain", "M4 C11 F3 P22", _VIEW_OUT,
       f"{_VIEW} order by abs(predicted_probability - 0.5), p.Ticker, date limit 10")
def _(t):
    return S.most_uncertain(t.spark, _tables(t))


@query("unmatched_companies", "C9 B9", "Ticker:s",
       "select distinct Ticker from f_articles where Ticker not in (select Ticker from f_companies where SectorCode > 1)")
def _(t):
    return unmatched(t.fixture("articles"), t.fixture("companies").filter("SectorCode > 1"), {"Ticker": "Ticker"})


_ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("column_catalog", "M5", "tabella:s nome_variabile:s tipo:s n:l",
       """select tabella, column_name as nome_variabile, n, case when column_type in ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') then 'intero'
            when column_type in ('DOUBLE', 'FLOAT') then 'decimale' when column_type = 'BOOLEAN' then 'booleano' when column_type = 'DATE' then 'data'
            when column_type like 'TIMESTAMP%' then 'data_ora' when column_type = 'VARCHAR' then 'testo' else 'array<' || lower(column_type[:-3]) || '>' end as tipo
          from (""" + " union all ".join(f"select '{t}' as tabella, column_name, column_type, (select count(*) from {t}) as n from (describe {t})" for t in _ALL) + ")")
def _(t):
    """All tables of the folder; the sizes come from one job."""
    tables = {n: t.raw(n) for n in _ALL}
    sizes = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).withColumn("tabella", F.lit(n)) for n, df in tables.items()])
    return column_catalog(tables).join(sizes, "tabella")


@query("global_order_position", "E20", "position:l o_orderkey:l",
       "select row_number() over (order by o_totalprice, o_orderkey) as position, o_orderkey from orders")
def _(t):
    return global_position(t.raw("orders"), [F.asc("o_totalprice"), F.asc("o_orderkey")], "position")


@query("accuracy_mismatches", "D10 P15 C1", "sector:s accuracy:d",
       f"""select sector, accuracy from (select sector, avg(cast(label = predicted as int)) as accuracy from ({PRED}) group by 1) a
           join f_best using (sector) where abs(accuracy - test_accuracy) > 0.000001""")
def _(t):
    return check_summary(predictions_of(t), t.fixture("best"))


@query("stored_by_entity", "A3 A8 A9", "Ticker:s n:l last:t",
       f"select Ticker, count(*) as n, max(WeekEndingFriday) as last from ({BARS}) group by Ticker")
def _(t):
    path = fresh_path(shared_dir(t.spark))
    write_by_entity(weekly_bars(t.fixture("daily")), path)
    back = t.spark.read.schema("Ticker string, WeekEndingFriday date, ClosePrice double, AdjClosePrice double").parquet(path)
    return back.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"), F.max("WeekEndingFriday").alias("last"))


@query("stored_table_columns", "A1 A2 A8", "Ticker:s n:l", f"select Ticker, count(*) as n from ({BARS}) where ClosePrice > 2000 group by Ticker")
def _(t):
    path = fresh_path(shared_dir(t.spark))
    write_table(weekly_bars(t.fixture("daily")), path, ["Ticker", "WeekEndingFriday"])
    schema = "Ticker string, WeekEndingFriday date, ClosePrice double, AdjClosePrice double"
    return read_table(t.spark, path, schema, ["Ticker", "ClosePrice"]).filter("ClosePrice > 2000").groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"))


@query("stored_refresh", "G6 A8 A11", "Ticker:s source:s n:l",
       """select Ticker, 'old' as source, count(*) as n from f_articles where Date < timestamp '2001-06-01' and Ticker not in
            (select Ticker from f_articles where Date >= timestamp '2001-06-01' and Headline like 'error 1%') group by 1
          union all select Ticker, 'new', count(*) from f_articles where Date >= timestamp '2001-06-01' and Headline like 'error 1%' group by 1""")
def _(t):
    path = fresh_path(shared_dir(t.spark))
    a = t.fixture("articles")
    cut = F.lit("2001-06-01").cast("timestamp_ntz")
    refresh_partitions(a.filter(F.col("Date") < cut).withColumn("source", F.lit("old")), path, "Ticker")
    new = a.filter((F.col("Date") >= cut) & F.startswith("Headline", F.lit("error 1")))
    refresh_partitions(new.withColumn("source", F.lit("new")), path, "Ticker")
    return t.spark.read.parquet(path).groupBy("Ticker", "source").agg(F.count(F.lit(1)).alias("n"))


@query("rows_before_after", "C16", "Ticker:s rows_before:l rows_after:l rows_delta:l",
       f"""select coalesce(b.Ticker, a.Ticker) as Ticker, coalesce(nb, 0) as rows_before, coalesce(na, 0) as rows_after, coalesce(na, 0) - coalesce(nb, 0) as rows_delta
           from (select Ticker, count(*) as nb from f_articles group by 1) b
           full join (select Ticker, count(distinct (ID, Date, Headline, Summary)) as na from f_articles where ID <> 'nan' group by 1) a using (Ticker)""")
def _(t):
    a = t.fixture("articles")
    after = a.filter("ID <> 'nan'").select("Ticker", "ID", "Date", "Headline", "Summary").distinct()
    return count_compare(a, after, "Ticker")


def _stream(t, name: str):
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def _run(writer) -> None:
    writer.start().awaitTermination()


def _in_files(t, df, cuts, base):
    """A stream of the cuts, in order, one a batch.

    Each cut is written by as many tasks as read the table, so none writes or reads a whole cut; small cuts are one file each. All cuts
    have the same number of files, which is what a batch takes: a thousand rows for each file at least, so that none stays away.
    """
    sizes = df.agg(*[F.count_if(F.expr(cut)) for cut in cuts]).first()
    files = max(1, min(df.rdd.getNumPartitions(), min((n for n in sizes if n), default=0) // 1000))
    for cut, n in zip(cuts, sizes, strict=True):
        if n or files == 1:
            dealt = df.filter(cut).coalesce(1) if files == 1 else df.filter(cut).repartition(files)
            dealt.write.mode("append").parquet(f"{base}/in")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")


@query("stream_weekly_counts", "K1", "event_type:s WeekEndingFriday:t n:l",
       f"select event_type, {FRI.format('cast(ts as date)')} as WeekEndingFriday, count(*) as n from events group by 1, 2")
def _(t):
    """Three files: the second brings late events of the weeks of the first. The batches are folded after two of them and after all."""
    base, keys = fresh_path(shared_dir(t.spark)), ["event_type", "WeekEndingFriday"]
    e = t.raw("events").select("event_id", "event_type", "ts")
    stream = _in_files(t, e, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], base)
    _run(write_batches(stream_weekly_counts(stream, "ts", ["event_type"], "4000 days"), f"{base}/counts", f"{base}/state", "update"))
    compact(t.spark, f"{base}/counts", keys)
    return latest_counts(t.spark, f"{base}/counts", ["event_type"])


@query("stream_late_events", "K1", "event_type:s kept:l late:l",
       """select event_type, count(*) filter (ts >= (select max(ts) from events) - interval '7' day) as kept, 0 as late from events group by 1""")
def _(t):
    """The newest days in two files, then all older events, which come behind the watermark of the first: their weeks stay as they were."""
    base = fresh_path(shared_dir(t.spark))
    e = t.raw("events").select("event_id", "event_type", "ts")
    first = F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr("interval 7 days")
    stream = _in_files(t, freeze(e.withColumn("recent", first)), ["recent and event_id % 2 = 0", "recent and event_id % 2 = 1", "not recent"], base)
    _run(write_batches(stream_weekly_counts(stream, "ts", ["event_type", "recent"], "1 day"), f"{base}/counts", f"{base}/state", "update"))
    seen = latest_counts(t.spark, f"{base}/counts", ["event_type", "recent"])
    of = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    return seen.groupBy("event_type").agg(of(F.col("recent")).alias("kept"), of(~F.col("recent")).alias("late"))


@query("stream_dedup_events", "K2", "user_id:l event_type:s n:l",
       "select user_id, event_type, count(distinct props) as n from events group by 1, 2")
def _(t):
    base = fresh_path(shared_dir(t.spark))
    e = _stream(t, "events").select(F.concat("event_type", F.lit("|"), "props").alias("ID"), F.col("user_id").cast("string").alias("Ticker"),
                                    F.col("ts").alias("Date"), "user_id", "event_type")
    _run(write_batches(stream_dedup_news(e, "60 days"), f"{base}/out", f"{base}/state"))
    return t.spark.read.parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert", "K3 G6", "event_type:s third:l n:l total:d",
       """select event_type, event_id % 3 as third, count(*) as n, sum(value) as total from events
          where event_id % 3 = case when event_type < 'm' then 2 else 1 end and not (event_type < 'm' and event_id % 3 < 2) group by 1, 2""")
def _(t):
    """Three files: all types twice, then some of them once more, so rows of both earlier files are replaced and others stay."""
    base = fresh_path(shared_dir(t.spark))
    cuts = ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2 and event_type < 'm'"]
    stream = _in_files(t, t.raw("events").select("event_id", "event_type", "value"), cuts, base)
    _run(stream_upsert(stream, f"{base}/table", "event_type", f"{base}/state"))
    return t.spark.read.parquet(f"{base}/table").groupBy("event_type", (F.col("event_id") % 3).alias("third")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("stream_score_new_texts", "K4 L2 C6", "digest:s FINBERT_Positive:d n:l",
       r"""with x as (select distinct trim(text) as x from documents where trim(text) not in ('', 'nan'))
           select md5(x) as digest, 1 as n, coalesce(round(len(list_filter(w, lambda v: list_contains(['gain','gains','profit','profits','growth','beat','beats','strong','rise','rises','record','up'], v)))
                  / nullif(len(w), 0), 4), 0) as FINBERT_Positive
           from (select x, string_split(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '[\s\p{Z}\x{1C}-\x{1F}\x{85}]+', ' ', 'g')),
                 'http[^\s\p{Z}]+|www[^\s\p{Z}]+', '', 'g'), '@[\p{L}\p{N}_]+|#', '', 'g'), '[^a-zA-Z ]', ' ', 'g')), ' +', ' ', 'g')), ' ') as w from x)""")
def _(t):
    """Three batches with repeats in one stream, then a second start of it that meets old texts; an older cache is taken over."""
    base = fresh_path(shared_dir(t.spark))
    keyed_state(t.spark)
    docs = t.raw("documents").select("doc_id", F.col("text").alias("Summary"), F.lit("").alias("Headline"))
    old = freeze(lexicon_scores(distinct_texts(analysis_text(docs.filter("doc_id % 10 = 0")))))
    stream = _in_files(t, docs, ["doc_id % 3 < 2", "doc_id % 3 > 0", "doc_id % 2 = 0"], base)
    _run(stream_score_new_texts(stream, f"{base}/cache", f"{base}/state", lexicon_scores, old))
    docs.write.mode("append").parquet(f"{base}/in")
    _run(stream_score_new_texts(stream, f"{base}/cache", f"{base}/state", lexicon_scores, old))
    scored = t.spark.read.parquet(f"{base}/cache").drop("batch_id").unionByName(old)
    return scored.groupBy(F.md5(F.col("AnalysisText").cast("binary")).alias("digest")).agg(
        F.max("FINBERT_Positive").alias("FINBERT_Positive"), F.count(F.lit(1)).alias("n"))


@query("newest_batch_per_key", "K3 G4", "o_custkey:l o_orderkey:l o_totalprice:d",
       "select o_custkey, arg_max(o_orderkey, (o_orderkey)) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1")
def _(t):
    o = t.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("batch_id"))
    return latest_per_key(o, ["o_custkey"])


@query("clean_news_sizes", "P7", "Ticker:s n:l",
       """select Ticker, count(*) as n from (select distinct Ticker, case when v then ID else cast(Date as varchar) || '|' || Headline || '|' || s end as k, v from (
            select *, case when trim(Summary) = '' then Headline else Summary end as s, lower(trim(coalesce(ID, ''))) not in ('', 'nan') as v from f_articles)) group by 1""")
def _(t):
    return clean_news(t.fixture("articles"), None, "1900-01-01", "2100-01-01").groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"))


