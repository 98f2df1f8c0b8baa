"""The corpus pipeline: quality, toxicity, near-duplicates, mixing and packing, each over all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.llm.common import read, words
from weekpanel.llm.mixing import mix
from weekpanel.llm.neardup import near_duplicates
from weekpanel.llm.packing import pack
from weekpanel.llm.quality import classify_quality
from weekpanel.llm.toxicity import classify_toxicity
from weekpanel.session import shared_dir
from weekpanel.sources.upsert import fresh_path


def _judged(docs: DataFrame, classify: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` whose verdict meets ``keep``; other columns travel under names that cannot clash."""
    names = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}
    judged = classify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return judged.where(keep).select(*[F.col(n).alias(c) for c, n in names.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Rows are judged one by one: NULL and empty texts are scored as empty ones,
    repeated rows share their verdict, and an empty table gives no rows."""
    return _judged(docs, lambda d: classify_quality(d, read(spark, sf_dir, "labels")), "predicted = 1")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, row by row: NULL and empty texts hold no insult and stay."""
    return _judged(docs, lambda d: classify_toxicity(d, read(spark, sf_dir, "labels")), "predicted = 0")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows that repeat an id and its text count as one; rows of one id with different texts are judged each by its own text. Rows without an
    id, texts without words and NULL texts stay. An empty table gives no rows.
    """
    name = "_hash"
    while name in docs.columns:
        name += "_"
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id", F.col("text_hash").alias(name)).distinct()
    hashed = docs.where("doc_id is not null").withColumn(name, F.xxhash64("text"))
    known = hashed.join(kept, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words weigh nothing and are
    taken as often as the rounded factor of their source; a NULL source is one of its own. An empty table gives no rows."""
    taken = mix(docs, F.size(words(F.col("text")))).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 4096 tokens, with their ids. A NULL text is packed as an empty one."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The classifiers are trained, the mix is drawn and tokens are made by a library: SQL can't express these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(shared_dir(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
