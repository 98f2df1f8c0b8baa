"""Article scores to weekly news features and the modeling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import MODEL_NEWS_COLUMNS
from weekpanel.functions.dates import market_week
from weekpanel.functions.numeric import to_double
from weekpanel.functions.text import collapse, normalize_id
from weekpanel.functions.windows import entity_window, zscore
from weekpanel.operators.joins import occurrence_join
from weekpanel.operators.ranking import WINDOW_ROWS
from weekpanel.operators.reshape import pivot_wide
from weekpanel.operators.rows import drop_incomplete, select_features

LAGS = [1, 2, 3]
SHARES = ["FINBERT_Negative", "FINBERT_Neutral", "FINBERT_Positive"]
BETAS = ["beta_negative", "beta_neutral", "beta_positive"]
NOT_METRICS = {"ID", "Ticker", "Date", "Headline", "Summary", "WeekEndingFriday"}
FINAL_SCORE = "NEWS_FINBERT_Granger_Score"


def score_name(lag: int) -> str:
    return f"FINBERT_GrangerArticleScore_Lag{lag}"


def attach_headline(scores: DataFrame, news: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Headline of each scored article: the n-th row of (ticker, date, id) on both sides."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"Ticker": collapse("Ticker"), "_id": normalize_id("ID")})

    if "Headline" in scores.columns:
        return scores.withColumn("Headline", collapse("Headline"))
    metrics = [F.col(f"`{c}`") for c in scores.columns if c not in ("Ticker", "Date", "ID")]
    right = keyed(news).withColumn("Headline", collapse("Headline")).select("Ticker", "Date", "_id", "Headline")
    out = occurrence_join(keyed(scores), right, ["Ticker", "Date", "_id"], metrics, [F.col("Headline")], ["Headline"], window_rows)
    return out.drop("_id").withColumn("Headline", collapse("Headline"))


def coefficients_wide(coefficients: DataFrame, lags: Sequence[int] = tuple(LAGS)) -> DataFrame:
    return pivot_wide(coefficients.withColumn("Ticker", collapse("Ticker")), "Ticker", "lag", lags, BETAS)


def sentiment_of(neg: Column, neu: Column, pos: Column) -> Column:
    """Positive minus negative; missing when any share is missing."""
    return pos - neg + 0.0 * neu


def weekly_news_features(articles: DataFrame, coefficients: DataFrame, metrics: Sequence[str] | None = None,
                         lags: Sequence[int] = tuple(LAGS), weekend_shift: str = "reference") -> DataFrame:
    """Means of all metrics over the distinct headlines of a ticker-week, with both article counts.

    ``articles`` holds Ticker, Date (UTC), Headline and the metrics. The first aggregate merges equal
    headlines and counts them, the second one averages, so the raw and the distinct count need no
    extra pass. The lag scores are linear in the three shares: their weekly mean is the combination
    of the mean shares over complete articles, so the coefficients are joined to ticker-weeks, not to
    articles.
    """
    metrics = list(metrics) if metrics is not None else [c for c in articles.columns if c not in NOT_METRICS]
    neg, neu, pos = (F.col(f"`{c}`") for c in SHARES)
    rows = articles.select(
        collapse("Ticker").alias("Ticker"), market_week("Date", weekend_shift).alias("WeekEndingFriday"),
        collapse("Headline").alias("Headline"), F.col("Date").alias("_date"),
        *[to_double(f"`{c}`").alias(c) for c in metrics],
    ).filter("WeekEndingFriday is not null and Ticker != '' and Headline != ''")
    first = F.min(F.struct("_date", *[F.col(f"`{c}`") for c in metrics])).alias("_r")
    distinct = rows.groupBy("Ticker", "WeekEndingFriday", "Headline").agg(first, F.count(F.lit(1)).alias("_n"))
    flat = distinct.select("Ticker", "WeekEndingFriday", "_n", *[F.col(f"_r.`{c}`").alias(c) for c in metrics])
    complete = neg.isNotNull() & neu.isNotNull() & pos.isNotNull()
    weekly = flat.groupBy("Ticker", "WeekEndingFriday").agg(
        *[F.avg(f"`{c}`").alias(f"NEWS_{c}_Mean") for c in metrics],
        F.avg(sentiment_of(neg, neu, pos)).alias("NEWS_Sentiment_Mean"),
        F.count(F.lit(1)).alias("NEWS_ArticleCount"), F.sum("_n").alias("NEWS_RawArticleCount"),
        *[F.avg(F.when(complete, F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(SHARES)],
    )
    wide = coefficients_wide(coefficients, lags)

    def combined(lag: int) -> Column:
        terms = [F.col(f"{b}_lag_{lag}") * F.col(f"_{i}") for i, b in enumerate(BETAS)]
        return (terms[0] + terms[1] + terms[2]).alias(f"NEWS_{score_name(lag)}_Mean")

    return weekly.join(wide, "Ticker", "left").select(
        "WeekEndingFriday", "Ticker", *[f"NEWS_{c}_Mean" for c in metrics], "NEWS_Sentiment_Mean",
        *[combined(lag) for lag in lags], "NEWS_ArticleCount", "NEWS_RawArticleCount",
    )


def granger_weekly_score(weekly: DataFrame, panel_keys: DataFrame, lags: Sequence[int] = tuple(LAGS)) -> DataFrame:
    """News features on the panel's weeks, and the standardised sum of the scores shifted by their lag.

    The windows run over one row per ticker and week.
    """
    keys = panel_keys.select("WeekEndingFriday", F.trim("Ticker").alias("Ticker")).distinct()
    aligned = keys.join(weekly, ["WeekEndingFriday", "Ticker"], "left")
    w = entity_window("Ticker", "WeekEndingFriday")
    shifted = aligned.withColumns({
        f"NEWS_{score_name(k)}_Shifted": F.lag(f"NEWS_{score_name(k)}_Mean", k).over(w) for k in lags
    })
    total = None
    for k in lags:
        c = F.col(f"NEWS_{score_name(k)}_Shifted")
        total = c if total is None else total + c
    return shifted.withColumn("_sum", total).withColumn(FINAL_SCORE, zscore("_sum", "Ticker")).drop("_sum")


def modeling_table(panel: DataFrame, aligned: DataFrame) -> DataFrame:
    """Panel with the allowed news columns, complete rows only."""
    news = select_features(aligned, prefix="NEWS_", keep_prefixed=MODEL_NEWS_COLUMNS)
    joined = panel.withColumn("Ticker", F.trim("Ticker")).join(news, ["WeekEndingFriday", "Ticker"], "left")
    return drop_incomplete(joined)
