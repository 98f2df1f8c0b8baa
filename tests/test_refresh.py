"""Versions, refreshes, compaction, keyed state, lasting keys and joins on heavy keys."""

from __future__ import annotations

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from weekpanel.contracts import ContractError
from weekpanel.operators.aggregates import exact_quantiles
from weekpanel.operators.heavy import heavy_keys, salted_lookup
from weekpanel.operators.joins import first_match, foreign_key
from weekpanel.operators.rows import filter_date_range, ties_of_best
from weekpanel.operators.textml import bag_of_words_long, tfidf_long
from weekpanel.plans.prices import price_features, weekly_bars
from weekpanel.plans.refresh import refresh_prices, stored_features
from weekpanel.plans.scoring import lexicon_scores
from weekpanel.plans.star import key_map, with_lasting_id
from weekpanel.session import shared_dir
from weekpanel.sources import versions
from weekpanel.sources.upsert import fresh_path
from weekpanel.streaming import jobs
from weekpanel.workload import load, star


def test_versions(spark):
    path = fresh_path(shared_dir(spark))
    assert versions.current(spark, path) is None
    versions.commit(spark.range(3), path)
    versions.commit(versions.current(spark, path).filter("id > 0"), path)
    os.makedirs(f"{path.removeprefix('file:')}/v=2")  # a load that did not finish
    assert rows(versions.current(spark, path)) == [(1,), (2,)]
    versions.commit(versions.current(spark, path).filter("id > 1"), path)
    versions.prune(spark, path)
    assert rows(versions.current(spark, path)) == [(2,)] and len(glob.glob(f"{path.removeprefix('file:')}/v=*")) == 1


def daily_of(spark, tickers=("A", "B", "C"), days=700):
    start = dt.date(2020, 1, 1)
    data = [(t, start + dt.timedelta(days=i), 100.0 + ((i * 7 + k) % 31), 90.0 + ((i * 5 + k) % 29)) for k, t in enumerate(tickers)
            for i in range(days) if (start + dt.timedelta(days=i)).weekday() < 5 and (i + k) % 11]
    return spark.createDataFrame(data, "Ticker string, ActualTradingDate date, ClosePrice double, AdjClosePrice double")


def test_refresh_computes_open_weeks_only(spark):
    daily, store = daily_of(spark).cache(), fresh_path(shared_dir(spark))
    day = F.col("ActualTradingDate")
    cuts = [dt.date(2021, 2, 17), dt.date(2021, 2, 25), dt.date(2021, 4, 13), dt.date(2030, 1, 1)]
    refresh_prices(store, daily.filter((day < cuts[0]) & (F.col("Ticker") != "C")))
    assert rows(stored_features(spark, store)) == rows(price_features(weekly_bars(daily.filter((day < cuts[0]) & (F.col("Ticker") != "C")))))
    folder = f"{store.removeprefix('file:')}/features"
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/period=2020*/part-*")}
    touched = refresh_prices(store, daily.filter((day >= cuts[0]) & (day < cuts[1]) & (F.col("Ticker") == "A")))
    assert touched == ["2021Q1"] and {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/period=2020*/part-*")} == before
    # B catches up over a gap, C is new, and some days of the last week come again
    refresh_prices(store, daily.filter(((day >= cuts[1] - dt.timedelta(days=2)) & (day < cuts[2]) & (F.col("Ticker") == "A"))
                                       | ((day >= cuts[0]) & (day < cuts[2]) & (F.col("Ticker") == "B")) | ((day < cuts[2]) & (F.col("Ticker") == "C"))))
    rest = daily.filter((day >= cuts[2]) & (day < cuts[3]))
    refresh_prices(store, rest)
    assert rows(stored_features(spark, store)) == rows(price_features(weekly_bars(daily)))
    refresh_prices(store, rest.filter(day > dt.date(2021, 11, 24)))  # a repeated load changes nothing
    assert rows(stored_features(spark, store)) == rows(price_features(weekly_bars(daily)))
    with pytest.raises(ContractError):
        refresh_prices(store, daily.filter(day < cuts[0]))


def test_keys_last(spark):
    store = fresh_path(shared_dir(spark))
    first = spark.createDataFrame([("b", 1), (None, 2), ("b", 3)], "k string, v int")
    assert rows(with_lasting_id(first, "id", ["k"], store).select("id", "k", "v")) == [(1, None, 2), (2, "b", 1), (3, "b", 3)]
    second = spark.createDataFrame([("a", 9), ("b", 1), ("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert rows(with_lasting_id(second, "id", ["k"], store).select("id", "k", "v")) == [(2, "b", 1), (3, "b", 3), (4, "a", 9), (5, "b", 4), (6, "c", 5)]
    assert key_map(first.limit(0), "id", ["k"], store).count() == 6  # a load without rows forgets nothing


def test_one_heavy_key_is_dealt_over_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    one = df.select("k").distinct().filter("k <> '0'").withColumn("n", F.length("k"))
    heavy = heavy_keys(df, ["k"], least=1000)
    assert rows(heavy) == [("hot",)]
    joined = salted_lookup(df, one, ["k"], "left", heavy)
    assert joined.count() == 20_000 and joined.filter("n is null").count() == 1 and joined.filter("k = 'hot' and n = 3").count() == 18_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in salted_lookup(df, one.hint("merge"), ["k"], "left", heavy).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 2.5 * 20_000 / len(sizes) and len(sizes) == 4
    t = df.select("k", (F.col("id") % 3).alias("m"), "id")
    assert ties_of_best(t, ["k"], "m", least=1000).count() == ties_of_best(t, ["k"], "m").count()
    right = spark.createDataFrame([("hot", 2, "x"), ("hot", 1, "y")], "k string, o int, v string")
    assert first_match(df, right, ["k"], [F.col("o")], ["v"]).filter("v = 'y'").count() == 18_000


def test_terms_of_all_documents(spark, monkeypatch):
    from weekpanel.operators import textml

    docs = spark.range(60).select("id", F.array(F.lit("everywhere"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("t"))
    plain = [rows(f(docs, "id", "t", max_df=1.0)) for f in (bag_of_words_long, tfidf_long)]
    monkeypatch.setattr(textml.on_vocabulary, "__defaults__", (1 / 64, 5))
    assert [rows(f(docs, "id", "t", max_df=1.0)) for f in (bag_of_words_long, tfidf_long)] == plain and len(plain[0]) == 120


@pytest.mark.parametrize("reach,size", [(0.01, 1024), (0.0001, 8)])
def test_quantiles_of_large_groups(spark, reach, size):
    """With a coarse sketch and a narrow reach ranks are missed at first and found in a wider interval."""
    rng = np.random.default_rng(3)
    data = {"even": rng.random(30_000), "steps": rng.integers(0, 4, 9000).astype(float), "long tail": np.exp(8 * rng.standard_normal(12_000)),
            "few": np.array([1.0, 2.0]), "one": np.array([5.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    p = [0.0, 0.25, 0.333, 0.5, 0.999, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(p))] for r in exact_quantiles(df, "g", "v", p, reach, size).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, p)), rel=1e-12)


def test_quantiles_with_nan(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, float("nan"), 3.0)] + [("b", float("nan")), ("c", None)], "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, "g", "v", [0.0, 1.0]).collect()}
    assert got["a"][0] == 1.0 and np.isnan(got["a"][1]) and np.isnan(got["b"][0]) and set(got) == {"a", "b"}


def test_counts_come_with_the_rows(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1)), ("b", dt.datetime(2020, 6, 1)), ("c", dt.datetime(2020, 6, 2)), ("d", None)], "k string, ts timestamp_ntz")
    seen, lost = Observation(), Observation()
    dim = spark.createDataFrame([("b", 7), ("c", 8), ("c", 9)], "k string, id long")
    out = foreign_key(filter_date_range(df, "ts", "2020-02-01", "2021-01-01", seen), dim, {"k": "k"}, "id", lost=lost)
    assert rows(out.select("id")) == [(7,)]
    assert seen.get == {"kept": 2, "dropped": 2} and lost.get == {"rows_in": 2, "rows_unmatched": 0, "rows_ambiguous": 1}


def test_each_text_is_scored_once_in_a_stream(spark):
    base, batches = fresh_path(shared_dir(spark)), []
    jobs.keyed_state(spark)
    df = spark.createDataFrame([(t, "") for t in ("gain a", "loss b", "known", "", "gain a")], "Summary string, Headline string")

    def scorer(texts):
        batches.append(sorted(r[0] for r in texts.collect()))
        return lexicon_scores(texts)

    known = spark.createDataFrame([("known",)], "AnalysisText string")
    for words in (["gain a", "loss b", "known", "", "gain a"], ["loss b", "new c"]):
        df.limit(0).union(spark.createDataFrame([(w, "") for w in words], df.schema)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.stream_score_new_texts(stream, f"{base}/cache", f"{base}/state", scorer, known).start().awaitTermination()
    df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    jobs.stream_score_new_texts(stream, f"{base}/cache", f"{base}/state", scorer, known).start().awaitTermination()
    assert [b for b in batches if b] == [["gain a", "loss b"], ["new c"]]
    assert rows(spark.read.parquet(f"{base}/cache").select("AnalysisText")) == [("gain a",), ("loss b",), ("new c",)]


def test_batches_are_folded(spark):
    path = fresh_path(shared_dir(spark))
    day = dt.date(2021, 1, 1)
    for batch, found in enumerate(([("a", day, 1), ("b", day, 1)], [("a", day, 3)], [("b", day, 2), ("c", day, 1)])):
        jobs.append_batch(spark.createDataFrame(found, "k string, WeekEndingFriday date, n long"), path, batch)
        if batch == 1:
            assert jobs.compact(spark, path, ["k", "WeekEndingFriday"]) == 2 and jobs.batch_numbers(spark, path) == []
    assert rows(jobs.latest_counts(spark, path, ["k"])) == [("a", day, 3), ("b", day, 2), ("c", day, 1)]
    assert jobs.compact(spark, path, ["k", "WeekEndingFriday"]) == 1 and jobs.compact(spark, path, ["k", "WeekEndingFriday"]) == 0
    assert rows(jobs.latest_counts(spark, path, ["k"])) == [("a", day, 3), ("b", day, 2), ("c", day, 1)]
    assert len(glob.glob(f"{path.removeprefix('file:')}_compacted/v=*")) == 1


def test_both_loads_read_the_stored_stages(spark, monkeypatch):
    """The articles are scored once for both loads of the star, not by every step that reads the scores."""
    class Enough(Exception):
        pass

    loads = []

    def load_star(store, *tables):
        loads.append(tables)
        if len(loads) == 2:
            raise Enough
        return {}

    monkeypatch.setattr(star.S, "star_schema", load_star)
    monkeypatch.setattr(star, "current", lambda *_: spark.range(0))
    with pytest.raises(Enough):
        load()["star_second_load"](spark, DATA)
    (_, _, _, _, _, scores, *_), (_, _, _, _, _, again, *_) = loads
    assert scores is again and "FileScan" not in scores._jdf.queryExecution().executedPlan().toString()
