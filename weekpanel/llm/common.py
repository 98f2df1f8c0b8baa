"""Shared pieces of the training-data operators."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks. In Python ``bytes.split()`` gives the same words.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a NULL id counts as the empty text and so is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5) -> DataFrame:
    """At most ``per_class`` labelled rows of each class to learn from: (text, label).

    Rows whose ``remainder`` is 0 are left out. Which rows are taken follows a hash of the id, so a rerun takes the
    same ones. Conflicting labels of one id count as 1; NULL labels and ids are passed over. The ids are broadcast:
    two times ``per_class`` of them at most.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
    )
    picked = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)
    ]
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").select("text", "label")
