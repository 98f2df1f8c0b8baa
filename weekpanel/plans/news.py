"""Clean news table: bounds, universe, summaries, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.text import is_blank
from weekpanel.operators.rows import add_missing_columns, dedup_two_branches, filter_date_range, filter_in

ARTICLE_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()), T.StructField("Ticker", T.StringType()),
    T.StructField("Date", T.TimestampNTZType()), T.StructField("Headline", T.StringType()),
    T.StructField("Summary", T.StringType()),
])
FALLBACK_KEY = ["Ticker", "Date", "Headline", "Summary"]


def fill_summary(news: DataFrame) -> DataFrame:
    """A missing or blank summary becomes the headline."""
    return news.withColumn(
        "Summary", F.when(is_blank("Summary"), F.coalesce("Headline", F.lit(""))).otherwise(F.col("Summary"))
    )


def dedup_news(news: DataFrame) -> DataFrame:
    return dedup_two_branches(news, "ID", "Ticker", FALLBACK_KEY)


def clean_news(news: DataFrame, universe: DataFrame | None, start: str, end_exclusive: str) -> DataFrame:
    """Articles of the universe inside the bounds, one row each."""
    shaped = add_missing_columns(news, ARTICLE_SCHEMA)
    if universe is not None:
        shaped = filter_in(shaped, "Ticker", universe.select("Ticker"))
    return dedup_news(fill_summary(filter_date_range(shaped, "Date", start, end_exclusive)))
