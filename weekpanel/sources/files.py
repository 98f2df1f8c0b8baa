"""Readers and writers of landed files and tables. Schemas are given, never inferred."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.dates import parse_utc

# Sentiment labels of the labelled sentences.
SENTIMENT_IDS = {"negative": 0, "neutral": 1, "positive": 2}

# Input schemas.
SCHEMAS = {
    "daily_prices": "Ticker string, ActualTradingDate date, ClosePrice double, AdjClosePrice double",
    "candidates": "symbol string, companyName string, sector string, industry string, exchangeShortName string, "
                  "universeSource string, marketCap double, ipoDate date, delistedDate date",
    "market_caps": "symbol string, date date, marketCap double",
    "enterprises": "Ticker string, companyName string, sector string, SectorCode int, industry string, "
                   "marketCap double, historicalMarketCapDate date, selectionReferenceDate date, universeSource string",
    "news_articles": "ID string, Ticker string, Date string, Headline string, Summary string",
    "coefficients": "Ticker string, lag int, alpha double, beta_negative double, beta_neutral double, "
                    "beta_positive double, n_obs_used int",
}


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] | None = None,
               multi_line: bool = False) -> DataFrame:
    """A catalogued table: Parquet by suffix or folder content, else CSV with a header.

    Values that do not fit the schema become NULL. ``multi_line`` is for tables whose texts hold line breaks; such a file cannot be
    split and is one task.
    """
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", multiLine=multi_line, escape='"')
    else:
        df = spark.read.schema(schema).parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_entity_files(spark: SparkSession, folder: str, suffix: str, schema: str | T.StructType,
                      entity: str = "Ticker", multi_line: bool = False) -> DataFrame:
    """One file per entity, ``<entity><suffix>``, as one table. One scan; the name gives the entity. ``multi_line`` as in ``read_table``."""
    glob = f"{folder.rstrip('/')}/*{suffix}"
    pattern = "^(.*)" + re.escape(suffix) + "$"
    df = spark.read.schema(schema).csv(glob, header=True, mode="PERMISSIVE", multiLine=multi_line, escape='"')
    name = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return df.select(name.alias(entity), *[F.col(f"`{c}`") for c in df.columns if c != entity])


def read_api_json(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Landed payloads: a list of rows, or ``{symbol, historical: [rows]}`` with the symbol copied down."""
    rows = T._parse_datatype_string(row_schema)
    fields = list(rows.fields)
    if "symbol" not in rows.names:
        fields.insert(0, T.StructField("symbol", T.StringType()))
    nested = T.StructType([*fields, T.StructField("historical", T.ArrayType(T.StructType(fields)))])
    raw = spark.read.schema(nested).json(path, multiLine=True)
    own = F.array(F.struct(*[F.col(f"`{f.name}`") for f in fields]))
    parts = raw.select(F.col("symbol").alias("_parent"), F.explode(F.coalesce("historical", own)).alias("r"))
    return parts.select(
        F.coalesce("r.symbol", "_parent").alias("symbol"),
        *[F.col(f"r.`{f.name}`") for f in fields if f.name != "symbol"],
    )


def read_news_json(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """``{news: [{id, created_at, headline, summary}]}`` as articles; the ticker defaults to the file name."""
    item = "array<struct<id:string, created_at:string, headline:string, summary:string>>"
    raw = spark.read.schema(f"news {item}").json(path, multiLine=True)
    name = F.lit(ticker) if ticker else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)
    rows = raw.select(name.alias("Ticker"), F.explode("news").alias("n"))
    empty = F.lit("")
    return rows.select(
        F.coalesce("n.id", empty).alias("ID"), "Ticker", parse_utc("n.created_at").alias("Date"),
        F.coalesce("n.headline", empty).alias("Headline"), F.coalesce("n.summary", empty).alias("Summary"),
    )


def read_model_results(spark: SparkSession, glob: str) -> DataFrame:
    """Ranking files ``{metric, ranking: [{model, test_accuracy, ...}]}`` of many sectors as one table.

    The sector is the folder two levels above the file, without its number.
    """
    schema = (
        "metric string, ranking array<struct<model:string, test_accuracy:double, validation_accuracy:double, "
        "best_params:map<string,string>>>"
    )
    raw = spark.read.schema(schema).json(glob, multiLine=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    sector = F.regexp_extract(path, r"/(?:\d+\.)?([^/]+)/[^/]+/[^/]+$", 1)
    rows = raw.select(sector.alias("sector"), "metric", F.posexplode("ranking").alias("position", "r"))
    return rows.select("sector", "metric", (F.col("position") + 1).alias("position"), "r.*")


def read_labeled_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 lines ``sentence@label``; the last ``@`` separates."""
    # The text source reads UTF-8 only; a CSV read with a separator no text holds gives decoded lines.
    lines = spark.read.schema("value string").csv(path, sep="\u0001", quote="", escape="", encoding="ISO-8859-1")
    return labeled_sentences(lines.filter(F.trim("value") != ""), "value")


def labeled_sentences(lines: DataFrame, column: str) -> DataFrame:
    pattern = r"(?s)^(.*)@([^@]*)$"
    label = F.lower(F.trim(F.regexp_extract(F.trim(F.col(column)), pattern, 2)))
    ids = F.create_map(*[F.lit(x) for kv in SENTIMENT_IDS.items() for x in kv])
    return lines.select(
        F.trim(F.regexp_extract(F.trim(F.col(column)), pattern, 1)).alias("sentence"),
        label.alias("label"), F.try_element_at(ids, label).alias("label_id"),
    )


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Parquet, sorted inside files so min/max statistics prune."""
    out = df.sortWithinPartitions(*[F.col(f"`{c}`") for c in (*partition_by, *sort_by)]) if sort_by else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_by_entity(df: DataFrame, path: str, entity: str = "Ticker", max_records: int = 5_000_000) -> None:
    """One folder per entity; a large entity is cut into several files.

    The rebalance hint gathers small entities and splits a hot one over several tasks; a plain
    repartition by entity would leave the hot one to a single task.
    """
    df.hint("rebalance", entity).write.mode("overwrite").partitionBy(entity).option("maxRecordsPerFile", max_records).option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def prune_entities(df: DataFrame, universe: DataFrame, entity: str = "Ticker") -> DataFrame:
    """Only rows of entities in the universe."""
    return df.join(universe.select(entity), entity, "left_semi")


def column_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: name, table, type label."""
    labels = {"int": "intero", "bigint": "intero", "smallint": "intero", "tinyint": "intero", "double": "decimale",
              "float": "decimale", "string": "testo", "date": "data", "timestamp": "data_ora",
              "timestamp_ntz": "data_ora", "boolean": "booleano"}
    rows = []
    for table, df in tables.items():
        for f in df.schema:
            kind = f.dataType.simpleString()
            rows.append((f.name, table, labels.get(kind, "decimale" if kind.startswith("decimal") else kind)))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "nome_variabile string, tabella string, tipo string")
