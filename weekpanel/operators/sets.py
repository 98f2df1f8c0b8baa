"""Unions, differences and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they are missing from."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer").filter("_a is null or _b is null")
    return both.select(key, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))


def key_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def shared_columns(candidates: Sequence[str], *frames: DataFrame) -> list[str]:
    """Candidates present in every table."""
    return [c for c in candidates if all(c in f.columns for f in frames)]


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a refreshed key come from the new batch; other keys keep their rows.

    An empty batch refreshes no key, so it changes nothing.
    """
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
