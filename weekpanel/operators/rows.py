"""Filters, projections and one-row-per-key choices.

Keeping the best row of a key is an aggregate (``max_by`` of a struct), not a window: rows are
combined before the shuffle, so a key that holds a third of the table ships one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.dates import in_range
from weekpanel.functions.text import is_blank, normalize_id
from weekpanel.operators.heavy import LEAST_ROWS, SHARE, salted_lookup

INLINE_VALUES = 1000


def _values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    field = df.schema[column]
    rows = [(v,) for v in values]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(column, field.dataType)])).distinct()


def filter_in(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is in a list, a scalar or a one-column table."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")
    values = [v for v in ([values] if isinstance(values, (str, int, float)) else values) if v is not None]
    if len(values) <= INLINE_VALUES:
        return df.filter(F.col(f"`{column}`").isin(values))
    return df.join(_values(df, column, values), column, "left_semi")


def filter_not_in(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is not in the list; a missing value is not in any list and stays, also where the list holds one."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_anti")
    values = [v for v in values if v is not None]
    if len(values) <= INLINE_VALUES:
        c = F.col(f"`{column}`")
        return df.filter(c.isNull() | ~c.isin(values))
    return df.join(_values(df, column, values), column, "left_anti")


def filter_date_range(df: DataFrame, ts: str, start: str, end_exclusive: str, seen: Observation | None = None) -> DataFrame:
    """Rows of the range. With ``seen`` kept and dropped rows are counted in the job that filters them, not in one of their own."""
    inside = in_range(ts, start, end_exclusive)
    if seen is not None:
        df = df.observe(seen, F.count_if(inside).alias("kept"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("dropped"))
    return df.filter(inside)


def count_out_of_range(df: DataFrame, ts: str, start: str, end_exclusive: str) -> DataFrame:
    """Kept and dropped rows of the date filter, in one pass."""
    inside = in_range(ts, start, end_exclusive)
    return df.agg(
        F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped")
    )


def filter_from(df: DataFrame, column: str, start: str) -> DataFrame:
    return df.filter(F.col(f"`{column}`") >= F.lit(start).cast(df.schema[column].dataType))


def filter_alive_on(df: DataFrame, start: str, end: str, day: str, column: str | None = None,
                    values: Sequence[str] = ()) -> DataFrame:
    """Rows whose interval holds the day; optionally only listed values of a column."""
    d = F.lit(day).cast("date")
    out = df.filter((F.col(start) <= d) & (F.col(end) >= d))
    return filter_in(out, column, values) if column else out


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=[f"`{c}`" for c in (subset or df.columns)])


def drop_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed keys; rows with a missing or empty one dropped."""
    out = df.withColumns({c: F.trim(F.col(c)) for c in columns})
    for c in columns:
        out = out.filter(~is_blank(c))
    return out


def select_features(df: DataFrame, drop: Iterable[str] = (), drop_containing: Iterable[str] = (),
                    prefix: str | None = None, keep_prefixed: Iterable[str] = ()) -> DataFrame:
    """Drop named columns, columns containing a tag, and prefixed columns outside the allow-list."""
    dropped, tags, kept = set(drop), list(drop_containing), set(keep_prefixed)

    def wanted(c: str) -> bool:
        if c in dropped or any(t in c for t in tags):
            return False
        return not (prefix and c.startswith(prefix) and c not in kept)

    return df.select(*[f"`{c}`" for c in df.columns if wanted(c)])


def filter_selected(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.select(*[f"`{c}`" for c in variables])


def rename_reorder(df: DataFrame, mapping: Mapping[str, str], leading: Sequence[str] = (),
                   drop_ignoring_case: Iterable[str] = ()) -> DataFrame:
    gone = {c.lower() for c in drop_ignoring_case}
    kept = [c for c in df.columns if c.lower() not in gone]
    out = df.select(*[f"`{c}`" for c in kept]).withColumnsRenamed(dict(mapping))
    rest = [c for c in out.columns if c not in leading]
    return out.select(*[f"`{c}`" for c in [*leading, *rest]])


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order; absent ones as NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def pick_field(df: DataFrame, candidates: Sequence[str], per_row: bool = False) -> Column:
    """The first candidate column the table has; ``per_row`` looks on when a row misses it."""
    present = [F.col(f"`{c}`") for c in candidates if c in df.columns]
    if not present:
        return F.lit(None)
    return F.coalesce(*present) if per_row else present[0]


def map_code(column: str | Column, mapping: Mapping) -> Column:
    """Label to code by a literal map; unknown labels give NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    c = F.col(column) if isinstance(column, str) else column
    return F.try_element_at(F.create_map(*pairs), c)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``order`` of every key; missing order values rank last.

    A missing key equals a missing key. The remaining columns break ties, so the choice does not
    depend on file order.
    """
    by = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    ties = [F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(tiebreak)]
    return _pick(df, keys, F.max, [*by, *ties])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ``order`` of every key (missing order values rank first)."""
    return _pick(df, keys, F.min, [o.alias(f"_o{i}") for i, o in enumerate(order)])


def _pick(df: DataFrame, keys: Sequence[str], best, by: Sequence[Column]) -> DataFrame:
    rest = [f"`{c}`" for c in df.columns if c not in keys]
    chosen = best(F.struct(*by, F.struct(*rest).alias("_row"))).alias("_best")
    picked = df.groupBy(*[f"`{k}`" for k in keys]).agg(chosen).select(*[f"`{k}`" for k in keys], "_best._row.*")
    return picked.select(*[f"`{c}`" for c in df.columns])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every group.

    Spark cuts each group to n rows before the shuffle (window group limit), so a large group costs
    at most n rows per task.
    """
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def ties_of_best(df: DataFrame, keys: Sequence[str], measure: str, share: float = SHARE, least: int = LEAST_ROWS) -> DataFrame:
    """All rows that share the largest measure of their group. The pass that finds it also counts, so heavy groups are dealt over many tasks."""
    best = df.groupBy(*keys).agg(F.max(measure).alias("_max"), F.count(F.lit(1)).alias("_n"))
    total = best.agg(F.sum("_n")).scalar()
    heavy = best.filter((F.col("_n") > least) & (F.col("_n") > share * total)).select(*keys)
    found = salted_lookup(df, best.drop("_n"), keys, "inner", heavy)
    return found.filter(F.col(measure) == F.col("_max")).select(*[F.col(f"`{c}`") for c in df.columns])


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def branch_key(id_column: str, key: str, fallback: Sequence[str]) -> Column:
    """Digest of (id, key) where the id is valid, else of key and fallback columns; a missing value equals a missing one."""
    valid = normalize_id(id_column) != ""
    parts = [F.when(valid, F.col(id_column)), F.col(key), *[F.when(~valid, F.col(c)) for c in fallback]]
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"f{i}") for i, p in enumerate(parts)])), 256)


def dedup_two_branches(df: DataFrame, id_column: str, key: str, fallback: Sequence[str]) -> DataFrame:
    """One row per (id, key) where the id is valid, one per fallback columns elsewhere.

    Both branches are one aggregate over a digest of the combined key, so texts are neither grouped nor sorted by.
    """
    columns = df.columns
    keyed = df.select(branch_key(id_column, key, fallback).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    return keyed.groupBy("_k").agg(F.min("_row").alias("_row")).select("_row.*")
