"""Exact positions in groups of any size.

``row_number`` over a window puts a whole group into one task. Three forms avoid that:

* ``bucketed_position`` when a coarse bucket rises with the order (a day, a hash range, a fraction
  step): rows are numbered inside (group, bucket) and the counts of the lower buckets are added;
* ``occurrence_index`` numbers groups with a plain window while the largest group is small (its size
  is counted first) and by range partitions beyond that;
* ``global_position`` numbers a whole table by range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.session import freeze

WINDOW_ROWS = 1_000_000
_INDEX_BITS = 33


def bucketed_position(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                      name: str = "position") -> DataFrame:
    """Row number (from 1) in each group by ``(bucket, *order)``.

    The bucket must rise with the order. The table of counts holds one row per (group, bucket); it is
    joined on the same columns the numbering is partitioned by, so the rows are shuffled once.
    """
    keys = list(keys)
    placed = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    sizes = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    same = [local[c].eqNullSafe(offsets[c]) for c in part]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return local.join(offsets, cond, "left").select(
        *[local[c] for c in df.columns], (F.col("_below") + F.col("_rn")).cast("long").alias(name)
    )


def _partition_index(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id is (partition << 33) + row; the frozen copy keeps it fixed.
    return freeze(placed.withColumn("_mid", F.monotonically_increasing_id())).withColumn(
        "_pid", F.shiftright("_mid", _INDEX_BITS)
    )


def global_position(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Dense number from 1 over a total order of the whole table, without a single-task window.

    One range shuffle; each partition is counted, and the offsets (one row per partition) are
    broadcast.
    """
    placed = _partition_index(df, order, partitions)
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    index = F.col("_mid") - F.shiftleft(F.col("_pid"), _INDEX_BITS)
    return placed.join(F.broadcast(offsets), "_pid").select(
        (F.col("_below") + index + 1).cast("long").alias(name), *[placed[f"`{c}`"] for c in df.columns]
    )


def _split_index(df: DataFrame, keys: list[str], order: list[Column], name: str, partitions: int | None) -> DataFrame:
    placed = _partition_index(df, [*[F.col(k) for k in keys], *order], partitions)
    part = [*keys, "_pid"]
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy("_mid")))
    # At most one group continues into each range partition, so this table has fewer rows than
    # there are partitions.
    below = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_below", F.sum("_n").over(below)).filter("_below is not null").select(*part, "_below")
    cond = local["_pid"] == offsets["_pid"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(offsets[k])
    return local.join(F.broadcast(offsets), cond, "left").select(
        *[local[f"`{c}`"] for c in df.columns],
        (F.coalesce(F.col("_below"), F.lit(0)) + F.col("_rn") - 1).cast("long").alias(name),
    )


def occurrence_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "occurrence",
                     window_rows: int = WINDOW_ROWS, partitions: int | None = None) -> DataFrame:
    """Number (from 0) of each row among the rows with the same key."""
    keys, order = list(keys), list(order)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= window_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    return _split_index(df, keys, order, name, partitions)


def largest_remainder(groups: DataFrame, keys: Sequence[str], weight: str, total: Column, order: Sequence[str],
                      name: str = "quota", steps: int = 4096, weight_sum: Column | None = None) -> DataFrame:
    """Share out ``total`` over the groups of each key in proportion to their weights.

    Everyone gets the floor of the exact share. What is left goes to the largest fractions, then the
    largest weights, then the order columns. The fraction is the coarse bucket of the ranking.
    """
    keys = list(keys)
    # without a key the sums are one row; the constant key keeps one code path
    base, by = (groups, keys) if keys else (groups.withColumn("_all", F.lit(1)), ["_all"])
    if weight_sum is None:
        base = base.join(base.groupBy(*by).agg(F.sum(weight).alias("_sum")), by)
    else:
        base = base.withColumn("_sum", weight_sum)
    with_total = base.withColumn("_total", total)
    exact = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum") * F.col("_total")).otherwise(F.lit(0.0))
    shares = (
        with_total.withColumn("_exact", exact)
        .withColumn("_base", F.floor("_exact"))
        .withColumn("_fraction", F.col("_exact") - F.col("_base"))
    )
    given = shares.groupBy(*by).agg(F.sum("_base").alias("_given"))
    ranked = bucketed_position(
        shares, by, -F.floor(F.col("_fraction") * steps),
        [F.col("_fraction").desc(), F.col(weight).desc(), *[F.col(c).asc() for c in order]], "_rank",
    )
    extra = (F.col("_rank") <= F.col("_total") - F.col("_given")).cast("long")
    return ranked.join(given, by).select(
        *[F.col(c) for c in groups.columns], (F.col("_base") + extra).cast("long").alias(name)
    )
