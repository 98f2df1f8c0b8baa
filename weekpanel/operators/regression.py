"""Vector autoregression and Granger tests per entity.

Least squares by stacked QR: every Arrow batch is reduced to one small triangular block per entity,
then the blocks of an entity (a few rows each) are stacked and reduced again. No task holds all rows
of an entity, and the near-collinear regressors (three shares that sum to one) are not squared as
they would be in normal equations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.windows import difference, entity_window


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    """P(F(d1, d2) > f), by the continued fraction of the incomplete beta function."""
    if not math.isfinite(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    return _beta_ratio(d2 / 2.0, d1 / 2.0, x)


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            delta = d * c
            h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def lagged_design(df: DataFrame, entity: str, time: str, target: str, regressors: Sequence[str], p: int,
                  differences: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows with the target now and all series at lags 1..p; rows with a missing value are dropped first.

    ``df`` holds one row per entity and time, so the lag window of an entity is bounded by the calendar.
    """
    series = [target, *regressors]
    whole = df.select(entity, time, *[F.col(f"`{c}`").cast("double").alias(c) for c in series]).na.drop("any")
    w = entity_window(entity, time)
    if differences:
        whole = whole.select(entity, time, *[difference(f"`{c}`", w).alias(c) for c in series]).na.drop("any")
    names, exprs = [], []
    for lag in range(1, p + 1):
        for c in series:
            names.append(f"L{lag}.{c}")
            exprs.append(F.lag(f"`{c}`", lag).over(w).alias(f"_x{len(names) - 1}"))
    design = whole.select(F.col(entity).alias("_entity"), F.col(f"`{target}`").alias("_y"), *exprs).na.drop("any")
    return design, names


def _triangle(block: np.ndarray) -> np.ndarray:
    return block if len(block) <= block.shape[1] else np.linalg.qr(block, mode="r")


def _reduce_batches(width: int):
    def run(batches):
        for pdf in batches:
            for entity, g in pdf.groupby("_entity", sort=False):
                x = g.drop(columns="_entity").to_numpy("float64")
                block = np.column_stack([np.ones(len(x)), x[:, 1:], x[:, 0]])
                r = _triangle(block)
                yield pd.DataFrame({"_entity": entity, "n": [len(x)] + [0] * (len(r) - 1), "r": list(r)})

    return run


def _solve(names: list[str], tested: list[int], min_rows: int):
    k = len(names) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        empty = pd.DataFrame(columns=["entity", "names", "beta", "n", "f", "df1", "df2", "p"], dtype=object)
        if n < min_rows:
            return empty
        stacked = np.vstack(pdf["r"].to_list())
        a, y = stacked[:, :k], stacked[:, k]
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)

        def rss(columns):
            sub = a[:, columns]
            b, *_ = np.linalg.lstsq(sub, y, rcond=None)
            return float(((y - sub @ b) ** 2).sum()), np.linalg.matrix_rank(sub)

        full, rank = rss(list(range(k)))
        small, small_rank = rss([i for i in range(k) if i not in tested])
        d1, d2 = rank - small_rank, n - rank
        f = ((small - full) / d1) / (full / d2) if d1 > 0 and d2 > 0 and full > 0 else float("nan")
        return pd.DataFrame({
            "entity": [pdf["_entity"].iloc[0]], "names": [["const", *names]], "beta": [beta.tolist()], "n": [n],
            "f": [f], "df1": [int(d1)], "df2": [int(d2)], "p": [f_upper_tail(f, d1, d2)],
        })

    return run


def var_fit(df: DataFrame, entity: str, time: str, target: str, regressors: Sequence[str], p: int,
            differences: bool = False, min_extra: int = 2) -> DataFrame:
    """Target equation of a VAR(p) per entity, with the F test that all regressor lags are zero.

    One row per entity: coefficient names and values, rows used, F, degrees of freedom, p-value.
    Entities with at most ``p + min_extra`` rows are skipped. The denominator has the rows minus the
    parameters of this equation.
    """
    design, names = lagged_design(df, entity, time, target, regressors, p, differences)
    tested = [i + 1 for i, n in enumerate(names) if n.split(".", 1)[1] != target]
    kind = design.schema["_entity"].dataType.simpleString()
    blocks = design.mapInPandas(_reduce_batches(len(names) + 2), f"_entity {kind}, n long, r array<double>")
    # rows of the series = rows of the design + p
    fitted = blocks.groupBy("_entity").applyInPandas(
        _solve(names, tested, max(min_extra + 1, 1)),
        f"entity {kind}, names array<string>, beta array<double>, n long, f double, df1 int, df2 int, p double",
    )
    return fitted.select(
        F.col("entity").alias(entity), F.map_from_arrays("names", "beta").alias("coefficients"),
        (F.col("n") + p).alias("n_obs_used"), F.col("f").alias("f_statistic"), "df1", "df2", F.col("p").alias("p_value"),
    )


def lag_coefficients(fitted: DataFrame, entity: str, lags: Sequence[int], regressors: dict[str, str],
                     digits: int = 7) -> DataFrame:
    """Long table (entity, lag, alpha, one beta per regressor). ``regressors`` maps output to series names."""
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(lag).alias("lag"),
            *[F.round(F.try_element_at("coefficients", F.lit(f"L{lag}.{c}")), digits).alias(o) for o, c in regressors.items()],
        )
        for lag in lags
    ])).alias("b")
    return fitted.select(
        entity, F.round(F.try_element_at("coefficients", F.lit("const")), digits).alias("alpha"), "n_obs_used", rows
    ).select(entity, "b.lag", "alpha", *[f"b.{o}" for o in regressors], "n_obs_used")


def granger_table(df: DataFrame, entity: str, time: str, target: str, regressors: Sequence[str],
                  orders: Sequence[int] = (1, 2)) -> DataFrame:
    """p-value per order on first differences, one row per entity."""
    out = None
    for p in orders:
        one = var_fit(df, entity, time, target, regressors, p, differences=True).select(
            entity, F.col("coefficients").alias(f"coefficients_lag{p}"), F.col("f_statistic").alias(f"f_lag{p}"),
            F.col("p_value").alias(f"pvalue_lag{p}"),
        )
        out = one if out is None else out.join(one, entity, "full_outer")
    return out
