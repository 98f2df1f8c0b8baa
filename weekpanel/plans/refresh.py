"""Refresh of the price panel from new daily prices, without the weeks that are finished.

A week's features need 12 earlier weeks and the next one. The store therefore keeps, beside the features laid out by quarter, a tail of
the last bars of every ticker. New prices are joined to the tail of their tickers only, so just the weeks from a ticker's last but one
on are computed, and only the quarters of those weeks are read and replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.contracts import PRICE_COLUMNS, ContractError
from weekpanel.functions.dates import week_ending_friday
from weekpanel.operators.rows import drop_incomplete, top_per_group
from weekpanel.plans.prices import price_features_all
from weekpanel.session import freeze
from weekpanel.sources.versions import commit, current, prune

OPEN_WEEKS = 2  # the last week may be half done, and the one before looks ahead to it
TAIL = OPEN_WEEKS + 12


def quarter(week: Column | str) -> Column:
    w = F.col(week) if isinstance(week, str) else week
    return F.concat(F.year(w).cast("string"), F.lit("Q"), F.quarter(w).cast("string"))


def dated_bars(daily: DataFrame) -> DataFrame:
    """Weekly bars with the trading day they come from, so that a half week can be replaced by the whole one."""
    day = F.col("ActualTradingDate")
    return daily.filter(day.isNotNull()).groupBy("Ticker", week_ending_friday(day).alias("WeekEndingFriday")).agg(
        F.max("ActualTradingDate").alias("day"), F.max_by("ClosePrice", day).alias("ClosePrice"), F.max_by("AdjClosePrice", day).alias("AdjClosePrice")
    )


def stored_features(spark: SparkSession, store: str) -> DataFrame:
    """Complete weeks of the stored panel, as ``price_features`` gives them for all prices."""
    return spark.read.parquet(f"{store}/features").select(*[F.col(f"`{c}`") for c in PRICE_COLUMNS])


def refresh_prices(store: str, daily: DataFrame) -> list[str]:
    """Bring the stored features up to date with new daily prices; returns the quarters that were replaced.

    ``daily`` holds the days since the last load of each of its tickers; days of the last stored week may come again. Days before a
    ticker's last but one stored week are an error, since its finished weeks are not computed again. A load that is repeated after a failure gives the same
    table: the features are replaced by quarter before the tail moves on.
    """
    spark = daily.sparkSession
    tail = current(spark, f"{store}/tail")
    fresh = freeze(dated_bars(daily))
    if tail is None:
        bars, since = fresh, None
    else:
        mine = tail.join(fresh.select("Ticker").distinct(), "Ticker", "left_semi")
        first_open = top_per_group(mine, ["Ticker"], [F.desc("WeekEndingFriday")], OPEN_WEEKS).groupBy("Ticker").agg(F.min("WeekEndingFriday").alias("since"))
        since = freeze(first_open)
        late = fresh.join(since, "Ticker").filter(F.col("WeekEndingFriday") < F.col("since")).limit(5).collect()
        if late:
            raise ContractError(f"prices of finished weeks: {late}")
        bars = freeze(mine.unionByName(fresh).groupBy("Ticker", "WeekEndingFriday").agg(
            F.max("day").alias("day"), F.max_by("ClosePrice", "day").alias("ClosePrice"), F.max_by("AdjClosePrice", "day").alias("AdjClosePrice")))
    made = price_features_all(bars)
    if since is not None:
        made = made.join(since, "Ticker", "left").filter(F.col("since").isNull() | (F.col("WeekEndingFriday") >= F.col("since"))).drop("since")
    made = freeze(drop_incomplete(made).withColumn("period", quarter("WeekEndingFriday")))
    touched = sorted(r[0] for r in made.select("period").distinct().collect())  # the open quarters; all of them in the first load
    if since is not None and touched:
        kept = spark.read.parquet(f"{store}/features").filter(F.col("period").isin(touched))
        made = freeze(made.unionByName(kept.join(made, ["Ticker", "WeekEndingFriday"], "left_anti").select(made.columns)))
    if touched:
        made.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{store}/features")
    others = [] if tail is None else [tail.join(fresh.select("Ticker").distinct(), "Ticker", "left_anti")]
    newest = top_per_group(bars, ["Ticker"], [F.desc("WeekEndingFriday")], TAIL)
    for df in others:
        newest = newest.unionByName(df)
    commit(newest, f"{store}/tail")
    prune(spark, f"{store}/tail")
    return touched
