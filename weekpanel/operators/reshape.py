"""Pivots, long forms and dense calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.text import label_column


def pivot_wide(df: DataFrame, key: str, by: str, values: Sequence, measures: Sequence[str], newest: str | None = None) -> DataFrame:
    """One row per key; columns ``<measure>_<by>_<value>``. Fixed values need no extra pass.

    Where a (key, value) pair occurs twice, the row with the largest ``newest`` gives all measures; ties, and all
    duplicates without such a column, go to the row with the largest measures. ``by`` values beyond the list drop out.
    """
    rank = F.struct(*([F.col(newest)] if newest else []), *[F.col(f"`{m}`") for m in measures])
    kept = df.groupBy(key, by).agg(F.max(rank).alias("_best")).select(key, by, *[F.col(f"_best.`{m}`").alias(m) for m in measures])
    out = kept.groupBy(key).pivot(by, list(values)).agg(*[F.first(m, ignorenulls=True).alias(m) for m in measures])
    if len(measures) == 1:
        return out.select(key, *[F.col(f"`{v}`").alias(f"{measures[0]}_{by}_{v}") for v in values])
    return out.select(key, *[F.col(f"`{v}_{m}`").alias(f"{m}_{by}_{v}") for m in measures for v in values])


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in columns], name, value)


def scores_to_columns(df: DataFrame, scores: str, prefix: str, labels: Sequence[str], digits: int = 4) -> DataFrame:
    """A list of (label, score) as one rounded column per label."""
    pairs = F.transform(scores, lambda s: F.struct(label_column(prefix, s["label"]).alias("k"), s["score"].alias("v")))
    m = F.map_from_entries(pairs)
    names = [f"{prefix}_{x.replace(' ', '_').capitalize()}" for x in labels]
    return df.withColumns({n: F.round(F.try_element_at(m, F.lit(n)), digits) for n in names}).drop(scores)


def dense_days(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every day between the first and the last one, per key when given."""
    bounds = df.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).filter("_lo is not null")
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))


def fill_calendar(counts: DataFrame, day: str, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing days added with 0."""
    calendar = dense_days(counts, day, keys)
    return calendar.join(counts, [*keys, day], "left").na.fill(0, subset=list(measures))


def calendar(spark, start: str, end: str) -> DataFrame:
    """Calendar dimension: ids from 1 in date order."""
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    return spark.range(1).select(day.alias("date")).select(
        (F.datediff("date", F.lit(start).cast("date")) + 1).alias("id_calendario"), "date"
    )


def split_xy(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    gone = {target, *exclude}
    x = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])
    return x, df.select(F.col(f"`{target}`"))


def year_between(day: Column | str, first: int, last: int) -> Column:
    """A range on the date itself, so partition and min/max pruning still work."""
    d = F.col(day) if isinstance(day, str) else day
    return (d >= F.lit(f"{first}-01-01").cast("date")) & (d < F.lit(f"{last + 1}-01-01").cast("date"))
