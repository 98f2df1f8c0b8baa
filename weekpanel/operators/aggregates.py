"""Aggregates: each is one pass with partial combine."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekpanel.functions.numeric import pct, safe_divide
from weekpanel.operators.joins import broadcast_if_small
from weekpanel.session import freeze

NATIVE_PAIRS = 200


def _q(name: str):
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of every metric per group; missing values and rows with a missing key do not count."""
    out = df
    for k in keys:
        out = out.filter(_q(k).isNotNull())
    return out.groupBy(*keys).agg(*[F.avg(_q(c)).alias(c) for c in columns])


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def mode_of(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; the smallest one wins a tie."""
    counts = df.filter(_q(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), _q(column).alias("v"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias(column), (-F.col("_b.n")).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and zero cells of every column: one pass, then one row per column."""
    columns = list(columns or df.columns)
    numeric = set(numeric_columns(df))
    zero = {c: F.count_if(_q(c) == 0) if c in numeric else F.lit(0).cast("long") for c in columns}
    wide = df.agg(*[
        F.struct(F.count_if(_q(c).isNull()).alias("missing"), zero[c].alias("zeros")).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}.missing").alias("missing"), F.col(f"_{i}.zeros").alias("zeros"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def entity_profile(df: DataFrame, entity: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Missing and zero cells per entity, as counts and shares of the cells."""
    columns = [c for c in df.columns if c not in {entity, *ignore}]
    numeric = [c for c in numeric_columns(df) if c in columns]

    def total(conditions):
        out = F.lit(0)
        for c in conditions:
            out = out + F.coalesce(c, F.lit(False)).cast("int")
        return F.sum(out).cast("long")

    counted = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("Rows"),
        total([_q(c).isNull() for c in columns]).alias("MissingValues"),
        total([_q(c) == 0 for c in numeric]).alias("ZeroValues"),
    )
    return counted.select(
        entity, "Rows", "MissingValues",
        pct("MissingValues", F.col("Rows") * max(len(columns), 1)).alias("MissingPct"),
        "ZeroValues",
        pct("ZeroValues", F.col("Rows") * max(len(numeric), 1)).alias("ZeroPct"),
    )


def accuracy(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = (_q(label) == _q(predicted)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, _q(label).alias("label"), _q(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then the macro and the weighted mean.

    Works on the confusion counts, which have one row per pair of classes. A ratio without cases is 0.
    """
    keys = list(keys)
    cells = confusion(df, label, predicted, keys)
    ends = cells.select(*keys, "label", "predicted", "n").withColumn(
        "parts",
        F.array(
            F.struct(F.col("label").cast("string").alias("class"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                     F.lit(0).cast("long").alias("pred"), F.col("n").alias("support")),
            F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("long").alias("tp"),
                     F.col("n").alias("pred"), F.lit(0).cast("long").alias("support")),
        ),
    )
    per = ends.select(*keys, F.explode("parts").alias("p")).select(*keys, "p.*").groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("support").alias("support")
    )
    zero = F.lit(0.0)
    per = per.select(
        *keys, "class",
        F.coalesce(safe_divide("tp", "pred"), zero).alias("precision"),
        F.coalesce(safe_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(safe_divide(F.col("tp") * 2, F.col("pred") + F.col("support")), zero).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )
    scores = ["precision", "recall", "f1"]
    macro = per.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.groupBy(*keys).agg(
        *[safe_divide(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    return per.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def _pair_moments(columns: list[str]):
    """Per task: counts and sums over the rows where both columns are present."""
    k = len(columns)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    iu, ju = np.triu_indices(k, 1)

    def run(batches):
        acc = np.zeros((6, len(iu)))
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype("float64")
            acc[0] += (mf.T @ mf)[iu, ju]
            sx = x0.T @ mf
            acc[1] += sx[iu, ju]
            acc[2] += sx[ju, iu]
            sq = (x0 * x0).T @ mf
            acc[3] += sq[iu, ju]
            acc[4] += sq[ju, iu]
            acc[5] += (x0.T @ x0)[iu, ju]
        yield pd.DataFrame({"a": iu.astype("int32"), "b": ju.astype("int32"), **dict(zip(names, acc))})

    return run


def _number(column: str) -> Column:
    """The column as a double, NaN as NULL."""
    c = _q(column).cast("double")
    return F.when(~F.isnan(c), c)


def correlation_pairs(df: DataFrame, columns: Sequence[str], native_pairs: int = NATIVE_PAIRS) -> DataFrame:
    """Pearson correlation of every pair (a before b), over the rows where both are present.

    NaN counts as missing; where one side is constant the correlation is NULL. A few pairs are one native aggregate. For wide tables every task adds up its own pair moments
    with matrix products, centred on the column means, and one small row per pair and task is
    shuffled.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    if len(pairs) <= native_pairs:
        numbers = df.select(*[_number(c).alias(f"_c{i}") for i, c in enumerate(columns)])
        at = {c: f"_c{i}" for i, c in enumerate(columns)}

        def pair(a: str, b: str) -> Column:
            x, y = F.col(at[a]), F.col(at[b])
            spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
            return F.try_divide(F.covar_pop(x, y), spread)

        wide = numbers.agg(*[pair(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
        rows = [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)
        ]
        return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    means = df.agg(*[F.avg(_number(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    centred = df.select(*[(_number(c) - F.lit(means[i] or 0.0)).alias(f"_{i}") for i, c in enumerate(columns)])
    moments = centred.mapInPandas(
        _pair_moments(columns),
        "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double",
    ).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = n * F.col("sxy") - sx * sy

    def deviation(squares: Column, total: Column) -> Column:
        rest = n * squares - total * total
        return F.when(rest > 1e-12 * n * squares, F.sqrt(rest)).otherwise(0.0)  # below that it is rounding of a constant

    spread = deviation(F.col("sxx"), sx) * deviation(F.col("syy"), sy)
    name = F.array(*[F.lit(c) for c in columns])
    return moments.select(
        F.get(name, F.col("a")).alias("a"), F.get(name, F.col("b")).alias("b"), safe_divide(cov, spread).alias("r")
    )


def exact_quantiles(df: DataFrame, group: str, value: str, probabilities: Sequence[float], reach: float = 0.01,
                    size: int = 1024) -> DataFrame:
    """Interpolated quantiles per group, one column ``q0, q1, ...`` each.

    A mergeable sketch gives an interval of values around each wanted rank. The second pass counts what lies below it and keeps
    only the values inside, about two times ``reach`` of a group, whose counts are cumulated; no task holds a group. Where a
    rank turns out to lie outside its interval, those groups are done again with a wider one. NaN counts as the largest value.
    """
    v = _q(value).cast("double")
    values = df.filter(v.isNotNull()).select(group, v.alias("_v"))
    sketched = values.groupBy(group).agg(
        F.kll_sketch_agg_double(F.when(~F.isnan("_v"), F.col("_v")), F.lit(size)).alias("_s"), F.count(F.lit(1)).alias("_total"),
        F.count_if(F.isnan("_v")).alias("_nan"),
    )
    def edge(i: int, p: float) -> Column:  # a small group has no more values than an interval may hold: all of them
        def near(r: float) -> Column:
            return F.kll_sketch_get_quantile_double("_s", F.lit(min(max(r, 0.0), 1.0)))

        end = near(float(i))
        return F.when(F.col("_total") == F.col("_nan"), None).when(F.col("_total") <= size, end).otherwise(near(p + (reach if i else -reach)))

    place = [(F.col("_total") - 1) * F.lit(float(p)) for p in probabilities]
    edges = [edge(i, float(p)) for p in probabilities for i in (0, 1)]
    bounds = sketched.select(group, "_total", *[e.alias(f"_{'lh'[i % 2]}{i // 2}") for i, e in enumerate(edges)])
    joined = values.join(broadcast_if_small(freeze(bounds)), group)
    tagged = F.array(*[
        F.when(F.isnan("_v") | (F.col("_v") >= F.col(f"_l{i}")), F.when(F.isnan("_v") | (F.col("_v") <= F.col(f"_h{i}")), F.struct(F.lit(i).alias("i"), F.col("_v").alias("v"))))
        .otherwise(F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
        for i in range(len(place))
    ])
    counted = joined.select(group, "_total", F.explode(F.filter(tagged, lambda x: x.isNotNull())).alias("t")).groupBy(
        group, "_total", "t.i", "t.v").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(group, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_n").over(ordered)).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("_start") <= rank) & (rank < F.col("_end")), F.col("v")))

    found = freeze(ranked.groupBy(group, "_total").agg(*[
        c for i, h in enumerate(place) for c in (at(i, F.floor(h)).alias(f"_a{i}"), at(i, F.ceil(h)).alias(f"_b{i}"))]))
    missed = F.greatest(*[F.col(f"_{c}{i}").isNull().cast("int") for i in range(len(place)) for c in "ab"]) == 1
    out = found.filter(~missed).select(group, *[
        F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(
            F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (h - F.floor(h))).alias(f"q{i}")
        for i, h in enumerate(place)
    ])
    again = found.filter(missed).select(group)
    if reach >= 1 or again.isEmpty():
        return out
    return out.unionByName(exact_quantiles(df.join(again, group, "left_semi"), group, value, probabilities, 10 * reach, size))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 interquartile ranges) and outlier count per group."""
    v = _q(value)
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75]).select(
        group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    ).withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    joined = df.filter(v.isNotNull()).select(group, v.alias("_v")).join(q, group)
    inside = (F.col("_v") >= F.col("q1") - F.col("_reach")) & (F.col("_v") <= F.col("q3") + F.col("_reach"))
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, value: str, bins: int = 16) -> DataFrame:
    """Equal bins between the smallest and the largest value; the last bin is closed. Empty bins show 0."""
    data = df.filter(_q(value).isNotNull()).select(_q(value).cast("double").alias("_v"))
    lo = data.agg(F.min("_v")).scalar()
    hi = data.agg(F.max("_v")).scalar()
    width = (hi - lo) / bins
    index = F.least(F.coalesce(F.floor(safe_divide(F.col("_v") - lo, width)), F.lit(0)), F.lit(bins - 1))
    counted = data.select(index.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every column, one row per column."""
    wide = df.agg(*[
        F.struct(F.avg(_q(c)).alias("mean"), F.stddev_pop(_q(c)).alias("std")).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}.mean").alias("mean"), F.col(f"_{i}.std").alias("std"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def sum_and_count(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(_q(value)).alias("total"), F.count(F.lit(1)).alias("n")).orderBy(
        F.col("total").desc(), F.col(group).asc()
    )


def share_of_total(counts: DataFrame, measure: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Each group's share of the sum over all groups (the sum is one row)."""
    total = counts.agg(F.sum(measure)).scalar()
    return counts.withColumn(name, pct(measure, total, digits))
