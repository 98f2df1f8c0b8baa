from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weekpanel.contracts import STATEMENT_FEATURES, fundamentals_columns
from weekpanel.operators.models import best_vs_baselines, coefficient_table, rank_models, selected_variables, standardise, standardise_fit
from weekpanel.plans.evaluation import best_model_predictions, evaluate
from weekpanel.plans.fundamentals import ITEMS, align_to_weeks, point_in_time_fundamentals, statement_factors
from weekpanel.plans.prices import price_features, weekly_bars
from weekpanel.plans.scoring import score_texts, score_with_cache
from weekpanel.plans.statements import merge_statements
from weekpanel.plans.star import dimensions, fact_results
from weekpanel.plans.summary_quality import classify_summary, impute_summary, summary_quality_report
from weekpanel.plans.training import train_and_rank
from weekpanel.plans.universe import select_universe
from weekpanel.plans.weekly_news import granger_weekly_score, weekly_news_features
from weekpanel.session import shared_dir
from weekpanel.sources import files
from weekpanel.sources.upsert import fresh_path, refresh_partitions
from weekpanel.streaming import jobs

FRIDAY = dt.date(2021, 1, 1)


def week(i):
    return FRIDAY + dt.timedelta(days=7 * i)


def statement(symbol, day, filing=None, accepted=None, **items):
    base = {c: 10.0 for c in ITEMS}
    base.update(items)
    return (symbol, day, filing, accepted, *[base[c] for c in ITEMS])


def statements_of(spark, data):
    return spark.createDataFrame(data, "symbol string, date date, filingDate date, acceptedDate date, " + ", ".join(f"{c} double" for c in ITEMS))


def bars_of(spark, n, symbol="A", skip=()):
    data = [(symbol, week(i), 100.0 + i, 50.0 + i) for i in range(n) if i not in skip]
    return spark.createDataFrame(data, "Ticker string, WeekEndingFriday date, ClosePrice double, AdjClosePrice double")


def test_weekly_bars_and_features(spark):
    daily = spark.createDataFrame(
        [("A", week(i) - dt.timedelta(days=k), 1.0 * i + k, 10.0 + i + (i % 3) + k) for i in range(20) for k in (0, 1, 3)],
        "Ticker string, ActualTradingDate date, ClosePrice double, AdjClosePrice double")
    bars = weekly_bars(daily)
    assert bars.count() == 20
    out = price_features(bars).orderBy("WeekEndingFriday").collect()
    assert [r["WeekEndingFriday"] for r in out] == [week(i) for i in range(12, 19)]


def test_values_are_filled_one_by_one_and_lags_are_not(spark):
    s = statements_of(spark, [
        statement("A", week(-10), week(-9), None, netIncome=1.0, marketCap=1000.0),
        statement("A", week(3), week(4), None, netIncome=None, marketCap=None, grossProfit=4.0),
    ])
    out = {r["WeekEndingFriday"]: r for r in point_in_time_fundamentals(s, bars_of(spark, 8), None).collect()}
    assert out[week(0)]["QuarterlyReleased"] == 0 and out[week(4)]["QuarterlyReleased"] == 1
    assert out[week(0)]["MarketCap"] == 1000.0  # seeded from before the first week
    assert abs(out[week(4)]["MarketCap"] - 1000.0 * 104.0 / 100.0) < 1e-9  # moved with the close
    assert out[week(5)]["ROA"] == 0.1 and out[week(5)]["GrossProfitability"] == 0.4
    assert out[week(5)]["ROA_L1Q"] == 0.1 and out[week(3)]["ROA_L1Q"] is None
    assert out[week(2)]["MarketCap_L2W"] == 1000.0 and out[week(1)]["MarketCap_L2W"] is None


def test_own_release_beats_the_seed_and_releases_off_the_grid_are_lost(spark):
    s = statements_of(spark, [statement("A", week(-20), week(-19), None, netIncome=1.0), statement("A", week(-1), week(0), None, netIncome=2.0),
                              statement("A", week(2), week(3), None, netIncome=3.0)])
    out = {r["WeekEndingFriday"]: r for r in align_to_weeks(statement_factors(s), bars_of(spark, 6, skip=(3,))).collect()}
    assert out[week(0)]["QuarterlyReleased"] == 1 and out[week(0)]["netIncome"] == 2.0
    assert all(r["QuarterlyReleased"] == 0 for w, r in out.items() if w != week(0))


def test_no_look_ahead(spark):
    data = [statement("A", week(5 * i), week(5 * i + 2), week(5 * i + 3), netIncome=1.0 + i, totalDebt=5.0, marketCap=100.0 + i) for i in range(8)]
    bars = bars_of(spark, 40)
    cut = week(21)
    full = point_in_time_fundamentals(statements_of(spark, data), bars, None).filter(F.col("WeekEndingFriday") <= F.lit(cut))
    known = [d for d in data if d[3] <= cut]
    part = point_in_time_fundamentals(statements_of(spark, known), bars.filter(F.col("WeekEndingFriday") <= F.lit(cut)), None)
    assert rows(full) == rows(part) and full.columns == ["WeekEndingFriday", "symbol", *fundamentals_columns()]


def test_debt_zero_between_positive_quarters_is_missing(spark):
    s = statements_of(spark, [statement("A", week(13 * i), week(13 * i), None, totalDebt=d, capitalExpenditure=x)
                              for i, (d, x) in enumerate([(5.0, 1.0), (0.0, 0.0), (7.0, -2.0)])])
    out = {r["date"]: r for r in statement_factors(s).collect()}
    assert [out[week(13 * i)]["DebtToAssets"] for i in range(3)] == [0.5, None, 0.7]
    assert [out[week(13 * i)]["InvestmentIntensity"] for i in range(3)] == [0.1, None, 0.2]
    assert set(STATEMENT_FEATURES) <= set(statement_factors(s).columns)


def test_statements_keep_the_newest_row_and_fall_back_by_column(spark):
    income = spark.createDataFrame([("A", "2021", 1.0, "2021-02-01"), ("A", "2021", 2.0, "2021-03-01")], "symbol string, date string, bottomLineNetIncome double, filingDate string")
    balance = spark.createDataFrame([("A", "2021", 5.0)], "symbol string, date string, totalEquity double")
    cash = spark.createDataFrame([("A", "2021", 7.0)], "symbol string, date string, freeCashFlow double")
    values = spark.createDataFrame([("B", "2021", 9.0)], "symbol string, date string, marketCap double")
    r = merge_statements(income, balance, cash, values).first()
    assert (r["netIncome"], r["totalStockholdersEquity"], r["freeCashFlow"], r["marketCap"], r["revenue"]) == (2.0, 5.0, 7.0, None, None)


def test_universe(spark):
    active = spark.createDataFrame([("x1", "One", "Energy", "i", 5.0), ("x2", "One", "Energy", "i", 4.0), ("x3", "Two", "Energy", "i", 3.0),
                                    ("HSBC", "Bank", "Financial Services", "i", 9.0), (" ", "No", "Energy", "i", 9.0)],
                                   "symbol string, companyName string, sector string, industry string, marketCap double")
    gone = spark.createDataFrame([("x3", "Two", "Energy", "NYSE", "2000-01-01", "2022-01-01"), ("x9", "Nine", "Energy", "NYSE", "2000-01-01", "2020-01-01")],
                                 "symbol string, companyName string, sector string, exchange string, i string, d string").selectExpr(
        "symbol", "companyName", "sector", "exchange", "cast(i as date) as ipoDate", "cast(d as date) as delistedDate")
    caps = spark.createDataFrame([("x1", "2021-01-05", 1.0), ("x1", "2021-01-04", 2.0), ("x2", "2020-12-30", 7.0), ("x3", "2021-01-15", 3.0), ("x3", "2021-02-15", 99.0)],
                                 "symbol string, d string, marketCap double").selectExpr("symbol", "cast(d as date) as date", "marketCap")
    out = {r["Ticker"]: r for r in select_universe(active, gone, caps, codes={"Energy": 5, "Financial Services": 6}).collect()}
    assert {k: v["marketCap"] for k, v in out.items()} == {"X2": 7.0, "X3": 3.0} and out["X3"]["universeSource"] == "active_screener" and out["X2"]["SectorCode"] == 5


@pytest.mark.parametrize("summary,headline,issue", [
    (None, "h", "missing"), ("  ", "h", "missing"), ("Short one here", "h", "too_short"),
    ("A long enough text that says this is a Headline Only Article today.", "h", "boilerplate"),
    ("According to the very latest company paperwork.", "h", "generic_feed_phrase"),
    ("The company moved on very quickly today following a report that", "h", "generic_feed_phrase"),
    ("Revenue at the company rose strongly over the whole year...", "h", "truncated"),
    ("Revenue at the company rose strongly over the", "h", "truncated"),
    ("Company revenue strongly rose during winter.", "Company revenue strongly rose during winter", "headline_like"),
    ("Winter during company revenue rises.", "Company revenue strongly rises during the winter", "headline_like"),
    ("Revenue at the company rose strongly over the whole year.", "Nothing alike", "usable"),
    ("Profit &amp; revenue at the company rose strongly.", "Nothing alike", "usable"),
])
def test_summary_classes(spark, summary, headline, issue):
    df = spark.createDataFrame([(headline, summary)], "Headline string, Summary string")
    assert classify_summary(df).first()["IssueType"] == issue
    fixed = impute_summary(df).first()["Summary"]
    assert (fixed == headline) == (issue != "usable")


def test_summary_report_shows_absent_classes(spark):
    df = classify_summary(spark.createDataFrame([("h", "")], "Headline string, Summary string"))
    out = {r["IssueType"]: r["n"] for r in summary_quality_report(df).collect()}
    assert out["missing"] == 1 and out["usable"] == 0 and len(out) == 8


def test_weekly_news_and_granger_score(spark):
    t = dt.datetime(2021, 1, 13, 15)
    data = [("A", t + dt.timedelta(days=7 * i), f"h{j}", 0.1 * i, 0.2, 0.3 + 0.1 * j) for i in range(6) for j in (0, 0, 1)]
    data += [("A", t, " ", 0.9, 0.9, 0.9), ("B", t, "x", 0.1, None, 0.5)]
    news = spark.createDataFrame(data, "Ticker string, d timestamp, Headline string, FINBERT_Negative double, FINBERT_Neutral double, FINBERT_Positive double")
    news = news.withColumn("Date", F.col("d").cast("timestamp_ntz")).drop("d")
    coeff = spark.createDataFrame([("A", k, 1.0 * k, 0.5, 2.0) for k in (1, 2, 3)], "Ticker string, lag int, beta_negative double, beta_neutral double, beta_positive double")
    weekly = weekly_news_features(news, coeff)
    out = {(r["Ticker"], r["WeekEndingFriday"]): r for r in weekly.collect()}
    first = out[("A", week(2))]
    assert (first["NEWS_ArticleCount"], first["NEWS_RawArticleCount"]) == (2, 3)
    assert abs(first["NEWS_FINBERT_Positive_Mean"] - 0.35) < 1e-12 and abs(first["NEWS_FINBERT_GrangerArticleScore_Lag2_Mean"] - 0.8) < 1e-12
    b = out[("B", week(2))]
    assert b["NEWS_Sentiment_Mean"] is None and b["NEWS_FINBERT_GrangerArticleScore_Lag1_Mean"] is None
    scored = granger_weekly_score(weekly, weekly).filter("Ticker = 'A'").orderBy("WeekEndingFriday").collect()
    assert [r["NEWS_FINBERT_Granger_Score"] is None for r in scored] == [True] * 3 + [False] * 3
    assert abs(sum(r["NEWS_FINBERT_Granger_Score"] for r in scored[3:])) < 1e-9


def test_cache_scores_only_new_texts(spark):
    news = spark.createDataFrame([("1", "A", "gain here", None), ("2", "A", "gain here", ""), ("3", "B", "old text", None), ("4", "B", None, None)],
                                 "ID string, Ticker string, Headline string, Summary string").withColumn("Date", F.lit(None).cast("timestamp_ntz"))
    cache = spark.createDataFrame([("old text", 0.1, 0.2, 0.3), ("gain here", None, None, 0.3)], "AnalysisText string, TEXTBLOB_Polarity double, FINBERT_Positive double, EMO_Joy double")

    def scorer(texts):
        def run(batch):
            assert "old text" not in batch
            return [{"TEXTBLOB_Polarity": 0.5, "FINBERT_Positive": 0.25, "EMO_Joy": 0.123456} for _ in batch]
        return score_texts(texts, run, ["TEXTBLOB_Polarity", "FINBERT_Positive", "EMO_Joy"], 2)

    out, fresh = score_with_cache(news, cache, scorer)
    assert rows(fresh.select("AnalysisText", "EMO_Joy")) == [("gain here", 0.1235)]
    assert rows(out.select("ID", "FINBERT_Positive")) == [("1", 0.25), ("2", 0.25), ("3", 0.2), ("4", None)]


def test_ranking_and_summary(spark):
    r = spark.createDataFrame([("s", "null_model", 0.6, 0), ("s", "always_one_model", 0.5, 1), ("s", "always_zero_model", 0.4, 2), ("s", "xgboost", 0.55, 4),
                               ("s", "random_forest", 0.55, 3)], "sector string, model string, test_accuracy double, o int")
    b = best_vs_baselines(r, order="o").first()
    assert b["best_model"] == "random_forest" and abs(b["delta_null_model"] + 0.05) < 1e-12 and abs(b["delta_always_zero"] - 0.15) < 1e-12
    assert [x["model"] for x in rank_models(r, order="o").orderBy("position").collect()][:3] == ["null_model", "random_forest", "xgboost"]


def test_selected_variables_and_scaler(spark):
    table = coefficient_table(spark, ["a", "b", "c"], [0.0, -2.0, 1.0])
    assert [r["feature"] for r in selected_variables(table).collect()] == ["b", "c"] and selected_variables(table, 1).count() == 1
    with pytest.raises(ValueError):
        selected_variables(table.filter("coefficient = 0"))
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "x double, y double")
    assert rows(standardise(df, standardise_fit(df, ["x", "y"]))) == [(-1.0, 0.0), (1.0, 0.0)]


def test_train_rank_and_predict(spark):
    data = [(f"T{t}", dt.date(y, 1, 1) + dt.timedelta(days=7 * w), 1.0, int((w + t) % 3 == 0), float((w + t) % 3 == 0) + 0.01 * w, float(w % 5), 1)
            for t in range(3) for y in (2023, 2025, 2026) for w in range(40)]
    df = spark.createDataFrame(data, "Ticker string, WeekEndingFriday date, `AdjClosePrice_t+1` double, `AdjClosePrice_t+1_Up` int, x double, z double, SectorCode int")
    out = train_and_rank(df, None, c_grid=[1.0], forest_grid=[{"numTrees": 5, "maxDepth": 3}], boost_grid=[{"maxIter": 3, "maxDepth": 2}],
                         net_grid=[{"hidden1": 4, "hidden2": 3, "max_iter": 20}], store=fresh_path(shared_dir(spark)))
    acc = {r["model"]: r["test_accuracy"] for r in out.collect()}
    assert len(acc) == 8 and acc["lasso_logistic"] > 0.9 and acc["always_zero_model"] > 0.6 and abs(acc["always_zero_model"] + acc["always_one_model"] - 1) < 1e-9

    test = df.filter(F.year("WeekEndingFriday") == 2026)
    p, summary = evaluate(test, out)
    assert summary.count() == 1 and p.count() == 120 and p.filter("predicted_probability < 0.5 or predicted_probability > 1").count() == 0
    for model in ("lasso_logistic", "logistic_regression", "random_forest", "xgboost", "neural_network"):  # each stored pipeline gives its own accuracy again
        one = best_model_predictions(test, out.filter(F.col("model").isin(model, "null_model", "always_one_model", "always_zero_model")))
        assert one.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] == pytest.approx(acc[model])
    with pytest.raises(ValueError):
        evaluate(test, out.withColumn("test_accuracy", F.lit(0.123)))


def test_unmatched_fact_is_an_error(spark):
    companies = spark.createDataFrame([("A", "Co", "Energy", 5, "oil")], "Ticker string, companyName string, sector string, SectorCode int, industry string")
    models = spark.createDataFrame([("Energy", "m", 0.5, 0.0, 0.0, 0.0)], "sector string, best_model string, test_accuracy double, delta_null_model double, delta_always_one double, delta_always_zero double")
    dims = dimensions(companies, models, "2021-01-01", "2021-12-31")
    ok = spark.createDataFrame([("A", week(0), "Energy", "m", 1, 0, 0.7)], "Ticker string, WeekEndingFriday date, sector string, best_model string, label int, predicted int, predicted_probability double")
    assert rows(fact_results(ok, dims).select("id_azienda", "id_calendario", "`AdjClosePrice_t+1`", "`predicted_AdjClosePrice_t+1`")) == [(1, 1, 1, 2)]
    with pytest.raises(Exception, match="no single row for"):
        fact_results(ok.withColumn("Ticker", F.lit("Z")), dims).collect()


def test_readers(spark, tmp_path):
    d = tmp_path / "prices"
    d.mkdir()
    for t in ("AAA", "BB.B"):
        (d / f"{t}Prices.csv").write_text("WeekEndingFriday,ClosePrice\n2021-01-01,1.5\n2021-01-08,oops\n")
    out = files.read_entity_files(spark, str(d), "Prices.csv", "WeekEndingFriday date, ClosePrice double")
    assert rows(out) == [("AAA", week(0), 1.5), ("AAA", week(1), None), ("BB.B", week(0), 1.5), ("BB.B", week(1), None)]
    (tmp_path / "a.json").write_text(json.dumps({"symbol": "X", "historical": [{"date": "2021-01-01", "v": 1.0}, {"date": "2021-01-02", "v": 2.0}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"symbol": "Y", "date": "2021-01-03", "v": 3.0}]))
    api = files.read_api_json(spark, str(tmp_path / "[ab].json"), "date string, v double")
    assert rows(api) == [("X", "2021-01-01", 1.0), ("X", "2021-01-02", 2.0), ("Y", "2021-01-03", 3.0)]
    (tmp_path / "NVDA.news.json").write_text(json.dumps({"news": [{"id": 7, "created_at": "2021-01-01T05:00:00Z", "headline": "h"}]}))
    n = files.read_news_json(spark, str(tmp_path / "NVDA.news.json")).first()
    assert (n["ID"], n["Ticker"], str(n["Date"]), n["Summary"]) == ("7", "NVDA", "2021-01-01 05:00:00", "")
    r = tmp_path / "3.Consumer Cyclical" / "results"
    r.mkdir(parents=True)
    (r / "model_comparison.json").write_text(json.dumps({"metric": "acc", "ranking": [{"model": "m", "test_accuracy": 0.5, "best_params": {"C": 1}}, {"model": "n", "test_accuracy": 0.4}]}))
    m = files.read_model_results(spark, str(tmp_path / "*" / "results" / "*.json")).orderBy("position").collect()
    assert [(x["sector"], x["model"], x["position"]) for x in m] == [("Consumer Cyclical", "m", 1), ("Consumer Cyclical", "n", 2)] and m[0]["best_params"] == {"C": "1"}
    (tmp_path / "s.txt").write_bytes("Caf\xe9 up a@b 5 @Positive\n\n".encode("latin-1"))
    assert rows(files.read_labeled_sentences(spark, str(tmp_path / "s.txt"))) == [("Café up a@b 5", "positive", 2)]


def test_refresh_replaces_only_its_keys_and_repeats_safely(spark):
    path = fresh_path(shared_dir(spark))
    refresh_partitions(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), path, "k")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    for df in (new, new, new.limit(0)):
        refresh_partitions(df, path, "k")
        assert rows(spark.read.parquet(path).select("k", "v")) == [("a", 9), ("b", 3)]


def test_streams_over_several_batches(spark, tmp_path):
    src, base = tmp_path / "in", fresh_path(shared_dir(spark))
    events = [(f"k{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(60)]
    df = spark.createDataFrame(events, "k string, ts timestamp")
    schema = df.schema
    for part in (events[:25], events[20:45], events[45:] + events[30:33]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        counts = jobs.stream_weekly_counts(spark.readStream.schema(schema).parquet(str(src)), "ts", ["k"], "60 days")
        jobs.write_batches(counts, f"{base}/c", f"{base}/s", "update").start().awaitTermination()
    batch = spark.read.schema(schema).parquet(str(src)).groupBy("k", F.next_day(F.date_sub(F.to_date("ts"), 1), "FRI").alias("w")).count()
    assert rows(jobs.latest_counts(spark, f"{base}/c", ["k"])) == rows(batch)
