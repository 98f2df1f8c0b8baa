"""Joins with a stated contract.

All are equi-joins left to Catalyst and AQE. A broadcast is forced only after the side was counted
against a bound; otherwise Spark decides from its own size statistics, and AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weekpanel.operators.heavy import salted_lookup
from weekpanel.operators.ranking import WINDOW_ROWS, occurrence_index

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the table proves to hold at most ``max_rows`` rows, else the table as is."""
    n = df.select(F.lit(1)).limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def left_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a dimension added to every row; the dimension key must be unique."""
    return df.join(dim.select(*on, *columns), list(on), "left")


def keep_universe(counts: DataFrame, universe: DataFrame, on: str, measures: Sequence[str]) -> DataFrame:
    """All members of the universe, absent ones with 0."""
    return counts.join(universe.select(on).distinct(), on, "right").na.fill(0, subset=list(measures))


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def occurrence_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column],
                    right_order: Sequence[Column], columns: Sequence[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Match duplicates one to one: the n-th row of a key on the left with the n-th on the right."""
    on = [*keys, "_nth"]
    numbered = occurrence_index(left, keys, left_order, "_nth", window_rows)
    other = occurrence_index(right.select(*keys, *columns), keys, right_order, "_nth", window_rows)
    return numbered.join(other, on, "left").drop("_nth")


def first_match(df: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column],
                columns: Sequence[str]) -> DataFrame:
    """For every row the first matching row of the right side, else NULL. Rows of a heavy key are dealt over many tasks."""
    by = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    picked = F.min(F.struct(*by, *[F.col(f"`{c}`") for c in columns])).alias("_first")
    first = right.groupBy(*on).agg(picked).select(*on, *[F.col(f"_first.`{c}`") for c in columns])
    return salted_lookup(df, first, on)


def unmatched(df: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Natural keys of the facts that the dimension does not hold."""
    keys = df.select(*[F.col(f"`{a}`").alias(b) for a, b in on.items()]).distinct()
    return keys.join(dim.select(*on.values()), list(on.values()), "left_anti")


def foreign_key(df: DataFrame, dim: DataFrame, on: Mapping[str, str], key: str, alias: str | None = None,
                lost: Observation | None = None) -> DataFrame:
    """Natural key to surrogate id; every fact must find exactly one row.

    ``on`` maps fact columns to dimension columns. The natural columns are dropped. The pass that looks up an id stops at a fact that
    finds none or several. With ``lost`` such facts are dropped instead and counted on the way: after the first action on the result the
    observation holds ``rows_in``, ``rows_unmatched`` and ``rows_ambiguous``.
    """
    names = {b: f"_k{i}" for i, b in enumerate(on.values())}
    side = dim.groupBy(*[F.col(f"`{b}`").alias(n) for b, n in names.items()]).agg(F.min(key).alias("_id"), F.count(F.lit(1)).alias("_rows"))
    out = df
    cond = None
    for a, b in on.items():
        eq = out[f"`{a}`"] == side[names[b]]
        cond = eq if cond is None else cond & eq
    columns = [out[f"`{c}`"] for c in df.columns if c not in on]
    joined = out.join(side, cond, "left")
    if lost is not None:
        seen = joined.observe(lost, F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("_rows").isNull()).alias("rows_unmatched"),
                              F.count_if(F.col("_rows") > 1).alias("rows_ambiguous"))
        return seen.filter("_rows = 1").select(*columns, F.col("_id").alias(alias or key))
    said = F.concat(F.lit(f"foreign key {dict(on)}: no single row for "), F.to_json(F.struct(*[out[f"`{a}`"].alias(a) for a in on])))
    found = F.when(F.col("_rows") == 1, F.col("_id")).otherwise(F.raise_error(said).cast("long")).alias(alias or key)
    return joined.select(*columns, found)


def as_of(df: DataFrame, keys: Sequence[str], day: str, value: str, reference: str) -> DataFrame:
    """Value on or first after the reference date, else the last one before it, with its date.

    One aggregate per key with partial combine; no window, no self-join.
    """
    ref = F.lit(reference).cast("date")
    d, v = F.col(day), F.col(value)
    after = F.min(F.when((d >= ref) & v.isNotNull(), F.struct(d.alias("d"), v.alias("v"))))
    before = F.max(F.when((d < ref) & v.isNotNull(), F.struct(d.alias("d"), v.alias("v"))))
    picked = df.groupBy(*keys).agg(F.coalesce(after, before).alias("_p")).filter("_p is not null")
    return picked.select(*keys, F.col("_p.v").alias(value), F.col("_p.d").alias(day))


def count_compare(before: DataFrame, after: DataFrame, on: str, alias: str = "rows") -> DataFrame:
    """Rows per key before and after, keys of either side, and the difference."""
    b = before.groupBy(on).agg(F.count(F.lit(1)).alias(f"{alias}_before"))
    a = after.groupBy(on).agg(F.count(F.lit(1)).alias(f"{alias}_after"))
    zero = F.lit(0).cast("long")
    return b.join(a, on, "full_outer").select(
        on,
        F.coalesce(f"{alias}_before", zero).alias(f"{alias}_before"),
        F.coalesce(f"{alias}_after", zero).alias(f"{alias}_after"),
        (F.coalesce(f"{alias}_after", zero) - F.coalesce(f"{alias}_before", zero)).alias(f"{alias}_delta"),
    )
