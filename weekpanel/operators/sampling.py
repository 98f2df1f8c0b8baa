"""Temporal and stratified splits, folds, and the balanced sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.operators.joins import broadcast_if_small
from weekpanel.operators.ranking import bucketed_position, largest_remainder
from weekpanel.operators.reshape import year_between
from weekpanel.session import freeze

HASH_BUCKETS = 4096


def temporal_split(df: DataFrame, date: str = "WeekEndingFriday", train=(2021, 2024), validation=(2025, 2025),
                   test=(2026, 2026)) -> dict[str, DataFrame]:
    """Three tables by the year of the week; incomplete rows are dropped first."""
    whole = df.na.drop("any", subset=[f"`{c}`" for c in df.columns])
    return {
        "train": whole.filter(year_between(date, *train)),
        "validation": whole.filter(year_between(date, *validation)),
        "test": whole.filter(year_between(date, *test)),
    }


def balance_binary(df: DataFrame, target: str, date: str = "WeekEndingFriday", entity: str = "Ticker",
                   per: Sequence[str] = ()) -> DataFrame:
    """Deterministic down-sampling of the larger class to the size of the smaller one.

    Quotas go to the (entity, year) groups of the larger class: one each when there are enough, the
    rest by largest remainder on the rows still available. Inside a group the rows are taken at even
    spacing in time. Nothing changes when there are not exactly two classes or they are equal.

    ``per`` balances each of its groups (such as sectors) on its own in the same job. Input holds one
    row per entity and week, so an (entity, year) group has at most 53 rows.
    """
    per = list(per)
    base = df if per else df.withColumn("_all", F.lit(1))
    by = per or ["_all"]
    tagged = base.withColumn("_year", F.year(date))
    groups = tagged.groupBy(*by, target, entity, "_year").agg(F.count(F.lit(1)).alias("_n"))
    classes = groups.groupBy(*by, target).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_groups"))
    ranked = F.struct("_size", F.col(f"`{target}`").alias("c"), "_groups")
    rule = classes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_classes"), F.min(ranked).alias("_lo"), F.max(ranked).alias("_hi")
    ).filter((F.col("_classes") == 2) & (F.col("_lo._size") < F.col("_hi._size"))).select(
        *by, F.col("_hi.c").alias("_major"), F.col("_hi._size").alias("_all_rows"), F.col("_hi._groups").alias("_groups"),
        F.col("_lo._size").alias("_keep"),
    )
    rule = rule if per else F.broadcast(rule)  # one row without groups
    major = groups.join(rule, by).filter(F.col(f"`{target}`") == F.col("_major"))
    enough = F.col("_keep") >= F.col("_groups")
    spare = F.when(enough, F.col("_all_rows") - F.col("_groups")).otherwise(F.col("_all_rows"))
    weighted = major.select(
        *by, entity, "_year", "_n", "_keep", "_groups", spare.alias("_spare"),
        F.when(enough, F.col("_n") - 1).otherwise(F.col("_n")).alias("_w"),
        F.when(enough, 1).otherwise(0).alias("_floor"),
    )
    totals = F.when(enough, F.col("_keep") - F.col("_groups")).otherwise(F.col("_keep"))
    quotas = largest_remainder(weighted, by, "_w", totals, [entity, "_year"], "_extra", weight_sum=F.col("_spare")).select(
        *by, entity, "_year", (F.col("_floor") + F.col("_extra")).alias("_q")
    )
    order = [F.col(date), *[F.col(f"`{c}`") for c in df.columns if c not in (date, entity, *per)]]
    w = Window.partitionBy(*by, F.col(f"`{target}`"), entity, "_year")
    numbered = tagged.withColumns({
        "_r": F.row_number().over(w.orderBy(*order)) - 1,
        "_n": F.count(F.lit(1)).over(w),
    })
    marked = numbered.join(rule.select(*by, "_major") if per else F.broadcast(rule.select(*by, "_major")), by, "left").join(quotas, [*by, entity, "_year"], "left")
    # Row r is taken when some i has floor((i + 0.5) * n / q) = r, that is when an i lies in
    # [r*q/n - 0.5, (r+1)*q/n - 0.5).
    first = F.ceil((F.col("_r") * F.col("_q")).cast("double") / F.col("_n") - 0.5)
    taken = ((first + 0.5) * F.col("_n") / F.col("_q")) < (F.col("_r") + 1)
    is_major = F.coalesce(F.col(f"`{target}`") == F.col("_major"), F.lit(False))
    q = F.coalesce(F.col("_q"), F.lit(0))
    keep = ~is_major | (q >= F.col("_n")) | ((q > 0) & (first < q) & taken)
    return marked.filter(F.coalesce(keep, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])


def _shuffled_position(df: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    """Position of every row in its class, in the order of a seeded hash of its key."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    hashed = df.withColumn("_h", h)
    return bucketed_position(
        hashed, [label], F.shiftright("_h", 64 - HASH_BUCKETS.bit_length() + 1), [F.col("_h"), *[F.col(k) for k in key]], "_pos"
    ).drop("_h")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], fraction: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test parts with the class shares of the whole; the test part has ``ceil(fraction * n)`` rows.

    Rows are numbered once and stored, so both parts come from one numbering.
    """
    numbered = _shuffled_position(df, label, key, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    quota = largest_remainder(sizes, [], "_n", F.ceil(F.lit(fraction) * F.col("_sum")), [label], "_test").drop("_n")
    columns = [F.col(f"`{c}`") for c in df.columns]
    inside = (F.col("_pos") <= F.col("_test")).alias("_inside")
    marked = freeze(numbered.join(broadcast_if_small(quota), label).select(*columns, inside))
    return marked.filter("not _inside").select(*columns), marked.filter("_inside").select(*columns)


def fold_assign(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42,
                name: str = "fold") -> DataFrame:
    """Stratified fold number 0..k-1 for every row."""
    numbered = _shuffled_position(df, label, key, seed)
    return numbered.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")
