"""Keyed refresh of stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh_partitions(new: DataFrame, path: str, key: str) -> None:
    """Replace all stored rows of the refreshed keys; other keys are neither read nor rewritten.

    The table is laid out by key, so this is a dynamic partition overwrite. An empty batch holds no
    key and changes nothing. Running the same batch again gives the same table. The rebalance hint
    lets AQE gather the rows of a key into few files and split a hot key over several tasks.
    """
    if new.isEmpty():
        return
    new.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_batch(new: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch in its own partition, so a repeated batch replaces itself."""
    new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str = "batch_id") -> DataFrame:
    """Newest stored version of every key."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = F.max(F.struct(F.col(order), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.r.*")


def fresh_path(base: str) -> str:
    """A new folder name below a shared folder."""
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
