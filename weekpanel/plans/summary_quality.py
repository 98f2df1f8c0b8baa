"""Summary quality classes, imputation and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions.numeric import pct
from weekpanel.functions.text import any_prefix, any_suffix, canonical, normalize_text, similar, tokens_contained, words

# Rules of the summary classes.
BOILERPLATE = [
    "headline only article",
    "benzinga pro traders",
    "benzinga does not provide investment advice",
    "all rights reserved",
    "to add benzinga news as your preferred source on google",
    "never miss a trade again",
]
GENERIC_SOURCES = ["benzinga", "bloomberg", "reuters", "upgrades", "downgrades", "the", "u.s.", "us"]
GENERIC_PREFIXES = ["according to", "shares of", "the stock", "stocks of"]
GENERIC_SUFFIXES = [
    "reported", "according to", "after a report emerged that", "following a report that", "following report",
    "amid reports", "on report",
]
MIN_WORDS, MIN_CHARS, SIMILARITY = 5, 25, 0.92

# Report order of the classes.
ISSUES = [
    "missing", "too_short", "generic_source_only", "boilerplate", "generic_feed_phrase", "truncated", "headline_like",
    "usable",
]


def issue_type(summary: Column, text: Column, head: Column, tokens: Column, head_tokens: Column,
               similarity: bool = True) -> Column:
    """Class of a summary; the first rule that holds wins.

    Takes the normalised summary, the canonical summary and headline and their words. Only the
    similarity rule needs Python, and only for pairs of nearly equal length.
    """
    n = F.size(tokens)
    last = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))
    ends_open = F.endswith(summary, F.lit("...")) | F.endswith(summary, F.lit("…"))
    cut_word = F.regexp_like(summary, F.lit(r"[\p{L}\p{N}]$")) & (n >= 6) & (F.length(last) <= 4)
    contained = tokens_contained(tokens, head_tokens) & (n <= 10)
    like = contained | similar(text, head, SIMILARITY) if similarity else contained
    return (
        F.when(summary == "", "missing")
        .when((F.length(summary) < MIN_CHARS) | (n < MIN_WORDS), "too_short")
        .when(text.isin(GENERIC_SOURCES), "generic_source_only")
        .when(F.regexp_like(F.lower(summary), F.lit("|".join(BOILERPLATE))), "boilerplate")
        .when(any_prefix(text, GENERIC_PREFIXES) & (n <= 9), "generic_feed_phrase")
        .when(any_suffix(text, GENERIC_SUFFIXES) & (n <= 12), "generic_feed_phrase")
        .when(ends_open | cut_word, "truncated")
        .when((head != "") & like, "headline_like")
        .otherwise("usable")
    )


def classify_summary(news: DataFrame, similarity: bool = True, unescape: bool = True) -> DataFrame:
    """Normalised headline and summary, word and character counts, class and fallback flag.

    The steps are separate projections, so each normal form is computed once per row.
    """
    clean = news.withColumns({
        "Headline": normalize_text("Headline", unescape), "Summary": normalize_text("Summary", unescape),
    })
    forms = clean.withColumns({"_text": canonical("Summary", True), "_head": canonical("Headline", True)})
    split = forms.withColumns({"_tokens": words("_text"), "_head_tokens": words("_head")})
    parts = [F.col(c) for c in ("Summary", "_text", "_head", "_tokens", "_head_tokens")]
    classed = split.withColumns({
        "SummaryWords": F.size("_tokens"), "SummaryChars": F.length("Summary"),
        "IssueType": issue_type(*parts, similarity=similarity),
    }).drop("_text", "_head", "_tokens", "_head_tokens")
    return classed.withColumn("NeedsHeadlineFallback", (F.col("IssueType") != "usable").cast("int"))


def impute_summary(news: DataFrame, similarity: bool = True, unescape: bool = True) -> DataFrame:
    """Every summary that is not usable becomes the headline."""
    classified = classify_summary(news, similarity, unescape)
    fixed = F.when(F.col("NeedsHeadlineFallback") == 1, F.col("Headline")).otherwise(F.col("Summary"))
    return classified.withColumn("Summary", fixed).select(*[F.col(f"`{c}`") for c in news.columns])


def summary_quality_report(classified: DataFrame) -> DataFrame:
    """Rows per class in the fixed order, with the share of all rows; absent classes show 0."""
    spark = classified.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(ISSUES)], "position int, IssueType string")
    counts = classified.groupBy("IssueType").agg(F.count(F.lit(1)).alias("n"))
    full = names.join(counts, "IssueType", "left").na.fill(0, subset=["n"])
    # the window holds one row per class
    return full.withColumn("_total", F.sum("n").over(Window.partitionBy(F.lit(1)))).select(
        "position", "IssueType", "n", pct("n", "_total", 1).alias("pct")
    )


def top_issues(report: DataFrame, k: int = 5) -> DataFrame:
    return report.filter("IssueType != 'usable'").orderBy(F.desc("n"), F.asc("position")).limit(k)
