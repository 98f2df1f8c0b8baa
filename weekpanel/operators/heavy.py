"""Joins of long tables whose keys may hold a large share of all rows.

A key that holds more than a share ``s`` of the rows is one of fewer than ``1 / s``, so the list of heavy keys has a proven bound and may
be broadcast. Rows of a heavy key get a salt, and the one row of the other side is repeated once for each salt; all other rows
join as they are. Everything is one pass over the long table and one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, LEAST_ROWS, SALTS = 1 / 64, 100_000, 64


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = SHARE, least: int = LEAST_ROWS) -> DataFrame:
    """(*on) of the keys with more than ``share`` of the rows and more than ``least`` rows: fewer than ``1 / share`` of them.

    The counts combine before the shuffle, so a heavy key costs a row for each task.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter((F.col("_n") > least) & (F.col("_n") > share * total)).select(*on)


def salted_lookup(df: DataFrame, one: DataFrame, on: Sequence[str], how: str = "left", heavy: DataFrame | None = None,
                  spread: Column | None = None, salts: int = SALTS) -> DataFrame:
    """``df`` joined to ``one``, which has at most one row for a key, with the rows of heavy keys dealt over ``salts`` tasks.

    ``heavy`` must be bounded, as ``heavy_keys`` is; without it, it is found first. ``spread`` says how the rows of a heavy
    key are dealt, by their other columns if it is not given, so a repeated task deals them alike.
    """
    on = list(on)
    listed = F.broadcast((heavy if heavy is not None else heavy_keys(df, on)).select(*on, F.lit(salts).alias("_salts")))
    others = [F.col(f"`{c}`") for c in df.columns if c not in on] or [F.lit(0)]
    dealt = spread if spread is not None else F.xxhash64(*others)
    many = df.join(listed, on, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(dealt, "_salts")).otherwise(F.lit(0)).cast("int"))
    few = one.join(listed, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return many.drop("_salts").join(few.drop("_salts"), [*on, "_salt"], how).drop("_salt")
