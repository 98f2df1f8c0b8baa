"""Star schema: dimensions, facts with foreign keys, and the three saved views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpanel.operators.joins import first_match, foreign_key
from weekpanel.operators.ranking import global_position, occurrence_index
from weekpanel.operators.reshape import calendar
from weekpanel.sources.versions import commit, current, prune

# Outcome labels.
OUTCOMES = [(1, "Up", 1), (2, "Down", 0)]
SCORES = ["NEWS_FINBERT_Granger_Score", "NEWS_Sentiment_Mean"]


def surrogate(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Progressive id from 1 for a dimension. Dimensions are small by nature (sectors, companies)."""
    return df.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def dimensions(companies: DataFrame, models: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """Sectors, industries, outcomes, models, calendar and companies (in ticker order)."""
    spark = companies.sparkSession
    sectors = surrogate(companies.select("sector", "SectorCode").distinct(), [F.asc("sector")], "id_settore")
    industries = surrogate(companies.select("industry").distinct(), [F.asc("industry")], "id_industry")
    ranked = surrogate(models, [F.asc("sector"), F.asc("best_model")], "id_best_model")
    people = surrogate(companies.select("Ticker", "companyName", "sector", "industry"), [F.asc("Ticker")], "id_azienda")
    firm = foreign_key(
        foreign_key(people, sectors, {"sector": "sector"}, "id_settore"),
        industries, {"industry": "industry"}, "id_industry",
    )
    return {
        "settori": sectors, "industrie": industries, "modelli": ranked,
        "possibili_risultati": spark.createDataFrame(OUTCOMES, "id_result long, result string, label int"),
        "calendario": calendar(spark, start, end), "aziende": firm,
    }


def numbered(df: DataFrame, order: list[Column], name: str, distributed: bool) -> DataFrame:
    """Progressive id of a fact. Large facts are numbered by range partitions, never in one task."""
    return global_position(df, order, name) if distributed else surrogate(df, order, name)


def link(df: DataFrame, dims: Mapping[str, DataFrame], ticker: str = "Ticker", day: str | None = None) -> DataFrame:
    """Company and calendar ids in place of ticker and day."""
    out = foreign_key(df, dims["aziende"], {ticker: "Ticker"}, "id_azienda")
    return foreign_key(out, dims["calendario"], {day: "date"}, "id_calendario") if day else out


def market_links(ids: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return link(ids, dims, day="WeekEndingFriday")


def article_links(ids: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    dated = ids.withColumn("Date", F.col("Date").cast("date")).withColumnRenamed("ID", "id_articoli_originali")
    return link(dated, dims, day="Date")


def indicator_links(ids: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return link(ids, dims, ticker="symbol", day="WeekEndingFriday")


def result_links(ids: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Company, day, model and both outcomes as ids."""
    outcome = dims["possibili_risultati"]
    linked = link(ids, dims, day="WeekEndingFriday")
    modelled = foreign_key(linked, dims["modelli"], {"sector": "sector", "best_model": "best_model"}, "id_best_model")
    actual = foreign_key(modelled, outcome, {"label": "label"}, "id_result", "AdjClosePrice_t+1")
    return foreign_key(actual, outcome, {"predicted": "label"}, "id_result", "predicted_AdjClosePrice_t+1")


def fact_market(prices: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return market_links(global_position(prices, [F.asc("Ticker"), F.asc("WeekEndingFriday")], "id_mercato"), dims)


def fact_articles(news: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """One row per article, in ticker and date order; the other columns settle ties."""
    rest = [F.asc(c) for c in ("ID", "Headline", "Summary")]
    ids = global_position(news, [F.asc("Ticker"), F.asc("Date"), *rest], "id_articoli")
    return article_links(ids, dims)


def fact_indicators(fundamentals: DataFrame, modeling: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Fundamentals with the news scores of the same ticker and week where the modeling table has them."""
    side = modeling.withColumnRenamed("Ticker", "symbol").select("symbol", "WeekEndingFriday", *SCORES)
    scored = first_match(fundamentals, side, ["symbol", "WeekEndingFriday"], [], SCORES)
    return indicator_links(global_position(scored, [F.asc("symbol"), F.asc("WeekEndingFriday")], "id_indicatori"), dims)


def fact_results(predictions: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Predictions with company, day, model and both outcomes as ids."""
    order = [F.asc("sector"), F.asc("Ticker"), F.asc("WeekEndingFriday")]
    return result_links(global_position(predictions, order, "id_risultati"), dims)


def fact_granger(granger: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    ids = global_position(granger, [F.asc("Ticker")], "id_granger")
    return link(ids, dims)


# Natural keys and surrogate names of the tables that get lasting ids, dimensions first.
DIMENSION_KEYS = {"settori": ("id_settore", ["sector"]), "industrie": ("id_industry", ["industry"]),
                  "modelli": ("id_best_model", ["sector", "best_model"]), "aziende": ("id_azienda", ["Ticker"])}
FACT_KEYS = {"mercato": ("id_mercato", ["Ticker", "WeekEndingFriday"]), "articoli": ("id_articoli", ["Ticker", "Date", "ID", "Headline", "Summary"]),
             "indicatori": ("id_indicatori", ["symbol", "WeekEndingFriday"]), "risultati": ("id_risultati", ["sector", "Ticker", "WeekEndingFriday"]),
             "granger": ("id_granger", ["Ticker"])}


def key_map(df: DataFrame, name: str, natural: Sequence[str], store: str) -> DataFrame:
    """Lasting ids: (key digest, copy, ``name``) of every natural key ever loaded, one row for each copy of it.

    Known keys keep their id; new ones are numbered behind the largest, in the order of their natural key. Only digests and ids are
    stored. The next version of the map is written and read back, the one before is removed.
    """
    spark = df.sparkSession
    counted = df.groupBy(*[F.col(f"`{c}`") for c in natural]).agg(F.count(F.lit(1)).alias("_n"))
    asked = counted.select(key_digest(natural).alias("key"), *[F.col(f"`{c}`") for c in natural],
                           F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("copy"))
    known = current(spark, store)
    order = [F.asc_nulls_first(f"`{c}`") for c in natural]
    if known is None:
        everything = global_position(asked, [*order, F.asc("copy")], name).select("key", "copy", name)
    else:
        last = known.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]
        new = asked.join(known, ["key", "copy"], "left_anti")
        numbered = global_position(new, [*order, F.asc("copy")], name)
        everything = known.select("key", "copy", name).unionByName(numbered.select("key", "copy", (F.col(name) + last).alias(name)))
    ids = commit(everything, store)
    prune(spark, store)
    return ids


def key_digest(natural: Sequence[str]) -> Column:
    """One short key for a natural key of several columns; NULL is a value of its own."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(natural)]), {"ignoreNullFields": "false"}), 256)


def with_lasting_id(df: DataFrame, name: str, natural: Sequence[str], store: str, window_rows: int = 1_000_000) -> DataFrame:
    """``df`` with its ids from the key map in ``store``; copies of one natural key are numbered by their other columns."""
    ids = key_map(df, name, natural, store)
    keyed = df.withColumn("key", key_digest(natural))
    rest = [F.asc_nulls_first(f"`{c}`") for c in df.columns if c not in natural]
    numbered = occurrence_index(keyed, ["key"], rest or [F.asc("key")], "copy", window_rows).withColumn("copy", F.col("copy") + 1)
    return numbered.join(ids, ["key", "copy"]).select(name, *[F.col(f"`{c}`") for c in df.columns])


def star_schema(store: str, companies: DataFrame, models: DataFrame, prices: DataFrame, news: DataFrame, fundamentals: DataFrame,
                modeling: DataFrame, predictions: DataFrame, granger: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """Six dimensions and five facts, stored once below ``store`` and returned as stored tables.

    A second load into the same folder replaces the tables, and every natural key that was loaded before keeps its id. Views and
    reports read the stored tables, so nothing is built anew for them.
    """
    spark = companies.sparkSession

    def stored(table: str, df: DataFrame) -> DataFrame:
        out = commit(df, f"{store}/tables/{table}")
        prune(spark, f"{store}/tables/{table}")
        return out

    def lasting(table: str, df: DataFrame) -> DataFrame:
        name, natural = (DIMENSION_KEYS | FACT_KEYS)[table]
        return with_lasting_id(df, name, natural, f"{store}/keys/{table}")

    dims: dict[str, DataFrame] = {
        "settori": stored("settori", lasting("settori", companies.select("sector", "SectorCode").distinct())),
        "industrie": stored("industrie", lasting("industrie", companies.select("industry").distinct())),
        "modelli": stored("modelli", lasting("modelli", models)),
        "possibili_risultati": stored("possibili_risultati", spark.createDataFrame(OUTCOMES, "id_result long, result string, label int")),
        "calendario": stored("calendario", calendar(spark, start, end)),
    }
    people = lasting("aziende", companies.select("Ticker", "companyName", "sector", "industry"))
    dims["aziende"] = stored("aziende", foreign_key(
        foreign_key(people, dims["settori"], {"sector": "sector"}, "id_settore"),
        dims["industrie"], {"industry": "industry"}, "id_industry",
    ))
    scores = modeling.withColumnRenamed("Ticker", "symbol").select("symbol", "WeekEndingFriday", *SCORES)
    facts = {
        "mercato": market_links(lasting("mercato", prices), dims),
        "articoli": article_links(lasting("articoli", news), dims),
        "indicatori": indicator_links(lasting("indicatori", first_match(fundamentals, scores, ["symbol", "WeekEndingFriday"], [], SCORES)), dims),
        "risultati": result_links(lasting("risultati", predictions), dims),
        "granger": link(lasting("granger", granger), dims),
    }
    return dims | {table: stored(table, df) for table, df in facts.items()}


_VIEW = """
SELECT a.companyName, a.Ticker, s.sector, c.date, pa.result AS actual_value, pp.result AS predicted_value,
       r.predicted_probability, m.best_model, m.test_accuracy, m.delta_null_model, m.delta_always_one,
       m.delta_always_zero, i.NEWS_FINBERT_Granger_Score, i.NEWS_Sentiment_Mean
FROM {risultati} r
JOIN {aziende} a ON r.id_azienda = a.id_azienda
JOIN {settori} s ON a.id_settore = s.id_settore
JOIN {calendario} c ON r.id_calendario = c.id_calendario
JOIN {modelli} m ON r.id_best_model = m.id_best_model
JOIN {possibili_risultati} pa ON r.`AdjClosePrice_t+1` = pa.id_result
JOIN {possibili_risultati} pp ON r.`predicted_AdjClosePrice_t+1` = pp.id_result
JOIN {indicatori} i ON r.id_azienda = i.id_azienda AND r.id_calendario = i.id_calendario
"""
_TABLES = ["risultati", "aziende", "settori", "calendario", "modelli", "possibili_risultati", "indicatori"]
_TAIL = ", a.Ticker, c.date"


def most_confident(spark: SparkSession, tables: Mapping[str, DataFrame], label: int, k: int = 10) -> DataFrame:
    """The k most confident predictions of one outcome (0 down, 1 up)."""
    text = _VIEW + f"WHERE pp.label = {int(label)} ORDER BY r.predicted_probability DESC{_TAIL} LIMIT {int(k)}"
    return spark.sql(text, **{t: tables[t] for t in _TABLES})


def most_uncertain(spark: SparkSession, tables: Mapping[str, DataFrame], k: int = 10) -> DataFrame:
    """The k predictions closest to even odds."""
    text = _VIEW + f"ORDER BY ABS(r.predicted_probability - 0.5) ASC{_TAIL} LIMIT {int(k)}"
    return spark.sql(text, **{t: tables[t] for t in _TABLES})
