"""Text scores with a persistent cache. Every distinct text is scored once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.numeric import safe_divide
from weekpanel.functions.text import canonical, text_or_headline, words
from weekpanel.session import freeze

TEXT = "AnalysisText"
FAMILIES = ["TEXTBLOB_", "FINBERT_", "EMO_"]

# Word lists of the built-in scorer.
POSITIVE = ["gain", "gains", "profit", "profits", "growth", "beat", "beats", "strong", "rise", "rises", "record", "up"]
NEGATIVE = ["loss", "losses", "drop", "drops", "fall", "falls", "weak", "miss", "misses", "lawsuit", "risk", "down"]
EMOTIONS = {"Joy": ["happy", "glad", "win", "wins", "record"], "Fear": ["fear", "risk", "panic", "crisis", "warning"]}


def digest(text: Column | str) -> Column:
    """Join key of a text: rows then travel without the text itself. Empty texts have none, so they never meet in one task."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c != "", F.sha2(c, 256))


def analysis_text(news: DataFrame) -> DataFrame:
    return news.withColumn(TEXT, text_or_headline("Summary", "Headline"))


def distinct_texts(news: DataFrame) -> DataFrame:
    """Non-empty texts, once each; copies are combined before the shuffle."""
    return news.filter(F.col(TEXT) != "").select(TEXT).distinct()


def lexicon_scores(texts: DataFrame) -> DataFrame:
    """Built-in scorer in native expressions: word shares as sentiment, polarity and emotions."""
    every = sorted({*POSITIVE, *NEGATIVE, *(w for v in EMOTIONS.values() for w in v)})

    def listed(words: str, lexicon: Sequence[str]) -> Column:
        return F.filter(words, lambda w: w.isin(list(lexicon)))

    def hits(lexicon: Sequence[str]) -> Column:
        return F.size(listed("_l", lexicon))

    # One pass over all words finds those of any list; each list then counts among these few.
    tokens = texts.withColumn("_c", canonical(TEXT)).withColumn("_w", words("_c"))
    counted = tokens.select(TEXT, F.size("_w").alias("_n"), listed("_w", every).alias("_l")).select(
        TEXT, "_n", hits(POSITIVE).alias("_p"), hits(NEGATIVE).alias("_m"), *[hits(v).alias(f"_e{k}") for k, v in EMOTIONS.items()],
    )

    def share(x: Column) -> Column:
        return F.round(F.coalesce(safe_divide(x, "_n"), F.lit(0.0)), 4)

    p, m = F.col("_p"), F.col("_m")
    return counted.select(
        TEXT,
        F.round(F.coalesce(safe_divide(p - m, p + m), F.lit(0.0)), 4).alias("TEXTBLOB_Polarity"),
        share(p + m).alias("TEXTBLOB_Subjectivity"),
        share(m).alias("FINBERT_Negative"),
        F.round(1.0 - share(p) - share(m), 4).alias("FINBERT_Neutral"),
        share(p).alias("FINBERT_Positive"),
        *[share(F.col(f"_e{k}")).alias(f"EMO_{k}") for k in EMOTIONS],
    )


def score_texts(texts: DataFrame, scorer: Callable[[list[str]], Iterable[Mapping[str, float]]], metrics: Sequence[str],
                batch_size: int = 128) -> DataFrame:
    """Scores of a plugged-in model.

    ``scorer`` takes a list of texts and gives one mapping of metric to value per text. It runs in
    Arrow batches inside the tasks; a model should be loaded on its first call.
    """

    def run(batches):
        for b in batches:
            for s in range(0, len(b), batch_size):
                part = b[TEXT].iloc[s:s + batch_size].tolist()
                rows = list(scorer(part))
                out = {TEXT: part}
                for m in metrics:
                    out[m] = [None if r.get(m) is None else round(float(r[m]), 4) for r in rows]
                yield pd.DataFrame(out)

    schema = T.StructType([T.StructField(TEXT, T.StringType()), *[T.StructField(m, T.DoubleType()) for m in metrics]])
    return texts.select(TEXT).mapInPandas(run, schema)


def usable_cache(cache: DataFrame, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """Cache rows with a key and at least one value in every metric family."""
    ok = F.col(TEXT).isNotNull() & (F.col(TEXT) != "")
    for prefix in families:
        columns = [c for c in cache.columns if c.startswith(prefix)]
        if not columns:
            return cache.limit(0)
        ok = ok & F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull()
    return cache.filter(ok)


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select(digest(TEXT).alias("_d"))
    return texts.withColumn("_d", digest(TEXT)).join(known, "_d", "left_anti").drop("_d")


def score_with_cache(news: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame] = lexicon_scores,
                     families: Sequence[str] = tuple(FAMILIES), newest: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """Scores of every article, and the rows to add to the cache.

    Only texts the cache does not cover are scored, once: their scores are stored before both results read them. Of several cache
    rows of a text the one with the largest ``newest`` counts (where the cache has that column), ties by the largest
    scores. Articles meet their scores over a text digest.
    """
    prepared = analysis_text(news)
    usable = usable_cache(cache, families)
    fresh = freeze(scorer(missing_texts(distinct_texts(prepared), usable)))
    known = usable.unionByName(fresh, allowMissingColumns=True)
    metrics = [c for c in known.columns if c not in (TEXT, newest)]
    order = [F.col(f"`{c}`") for c in ([newest] if newest in known.columns else []) + metrics]
    side = known.select(digest(TEXT).alias("_d"), F.struct(*order).alias("_s")).groupBy("_d").agg(F.max("_s").alias("_s"))
    side = side.select("_d", *[F.col(f"_s.`{c}`").alias(c) for c in metrics])
    articles = prepared.select("ID", "Ticker", "Date", digest(TEXT).alias("_d"))
    return articles.join(side, "_d", "left").drop("_d"), fresh
