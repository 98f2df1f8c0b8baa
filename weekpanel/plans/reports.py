"""Profiles, comparisons and the frames behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions.dates import week_ending_friday
from weekpanel.functions.numeric import pct
from weekpanel.functions.windows import entity_window, moving_average, pct_change, running_total
from weekpanel.operators.aggregates import correlation_pairs, numeric_columns
from weekpanel.operators.joins import count_compare
from weekpanel.operators.reshape import fill_calendar
from weekpanel.operators.rows import top_per_group

NEWS = "NEWS_"


def _any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(f"`{c}`").isNull()
    return out


def _all_null(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNull()
    return out


def missing_profile(df: DataFrame, entity: str = "Ticker") -> DataFrame:
    """Per entity: rows, rows with any missing value, with missing news and with other missing values."""
    news = [c for c in df.columns if c.startswith(NEWS)]
    other = [c for c in df.columns if not c.startswith(NEWS)]
    counted = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("TotalRows"),
        F.count_if(_any_null(df.columns)).alias("RowsWithAnyMissing"),
        F.count_if(_any_null(news)).alias("RowsWithAnyNewsMissing"),
        F.count_if(_all_null(news)).alias("RowsWithAllNewsMissing"),
        F.count_if(_any_null(other)).alias("RowsWithAnyNonNewsMissing"),
    )
    shares = {"AnyMissing": "RowsWithAnyMissing", "AnyNewsMissing": "RowsWithAnyNewsMissing",
              "AllNewsMissing": "RowsWithAllNewsMissing", "AnyNonNewsMissing": "RowsWithAnyNonNewsMissing"}
    return counted.select("*", *[pct(c, "TotalRows").alias(f"Pct{n}") for n, c in shares.items()])


def correlation_report(df: DataFrame, threshold: float = 0.2, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs of different columns with an absolute correlation of at least the threshold."""
    return correlation_pairs(df, columns or numeric_columns(df)).filter(F.abs("r") >= threshold)


def target_correlations(df: DataFrame, target: str, k: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """Features by absolute correlation with the target."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    wide = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), F.col(f"`{target}`").cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("r")) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("x")).select("x.*").filter("r is not null").orderBy(
        F.abs("r").desc(), F.asc("feature")
    ).limit(k)


def compact_matrix(df: DataFrame, target: str, k: int = 15, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation pairs among the target and its k closest features (k names reach the driver)."""
    names = [r["feature"] for r in target_correlations(df, target, k, columns).collect()]
    return correlation_pairs(df, [target, *names])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row counts per key in both snapshots, largest change first."""
    compared = count_compare(before, after, key)
    state = F.when(F.col("rows_before") == 0, "added").when(F.col("rows_after") == 0, "removed").otherwise("kept")
    return compared.withColumn("status", state).orderBy(F.abs("rows_delta").desc(), F.asc(key))


def snapshot_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows and keys of both snapshots and the keys added and removed. Columns are compared by name."""
    c = count_compare(before, after, key)
    new, gone = sorted(set(after.columns) - set(before.columns)), sorted(set(before.columns) - set(after.columns))
    return c.agg(
        F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"),
        F.count_if(F.col("rows_before") > 0).alias("keys_before"), F.count_if(F.col("rows_after") > 0).alias("keys_after"),
        F.count_if(F.col("rows_before") == 0).alias("keys_added"), F.count_if(F.col("rows_after") == 0).alias("keys_removed"),
    ).withColumns({
        "columns_added": F.lit(",".join(new)), "columns_removed": F.lit(",".join(gone)),
    })


def recent_weeks(prices: DataFrame, weeks: int, start: str) -> DataFrame:
    """The last weeks of every ticker, not before the start day; 0 keeps all weeks from the start."""
    kept = prices.filter(F.col("WeekEndingFriday") >= F.lit(start).cast("date")) if weeks <= 0 else top_per_group(
        prices, ["Ticker"], [F.col("WeekEndingFriday").desc()], weeks
    )
    return kept.filter(F.col("WeekEndingFriday") >= F.lit(start).cast("date"))


def company_frames(bars: DataFrame, news: DataFrame, weeks: int = 0, start: str = "2021-01-01") -> DataFrame:
    """Price, weekly return, six-week mean and news count of every ticker and week.

    News weeks are plain calendar weeks here. All companies come out of one job.
    """
    w = entity_window("Ticker", "WeekEndingFriday")
    priced = bars.filter("AdjClosePrice is not null").select(
        "Ticker", "WeekEndingFriday", F.col("AdjClosePrice").alias("DisplayPrice"),
        pct_change("AdjClosePrice", 1, w).alias("WeeklyReturn"),
    )
    counts = news.filter("Date is not null").groupBy(
        "Ticker", week_ending_friday(F.col("Date").cast("date")).alias("WeekEndingFriday")
    ).agg(F.count(F.lit(1)).alias("NewsCount"))
    recent = recent_weeks(priced, weeks, start)
    joined = recent.join(counts, ["Ticker", "WeekEndingFriday"], "left").na.fill(0, subset=["NewsCount"])
    return joined.withColumn("MA_6W", moving_average("DisplayPrice", 6, w))


def company_summary(frames: DataFrame) -> DataFrame:
    """Cumulative and mean return and total news per ticker."""
    first = F.min_by("DisplayPrice", "WeekEndingFriday")
    last = F.max_by("DisplayPrice", "WeekEndingFriday")
    agg = frames.groupBy("Ticker").agg(
        first.alias("_first"), last.alias("RecentPrice"), F.avg("WeeklyReturn").alias("MeanWeeklyReturn"),
        F.sum("NewsCount").alias("TotalNews"),
    )
    grown = F.when(F.coalesce(F.col("_first"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("RecentPrice") / F.col("_first") - 1)
    return agg.select("Ticker", "RecentPrice", grown.alias("CumulativeReturn"), "MeanWeeklyReturn", "TotalNews")


def daily_activity(events: DataFrame, ts: str) -> DataFrame:
    """Events per day with empty days, and the running total. One row per day reaches the last window."""
    counts = events.filter(F.col(ts).isNotNull()).groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return fill_calendar(counts, "day", ["n"]).withColumn("running_total", running_total("n", Window.orderBy("day")))
