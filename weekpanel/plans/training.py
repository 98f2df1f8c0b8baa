"""Splits, models and ranking per sector."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import BASELINES, TARGET, assert_not_empty
from weekpanel.operators import models as M
from weekpanel.operators.sampling import balance_binary, temporal_split
from weekpanel.session import freeze

# Execution order of the models, which settles ties in the ranking.
MODEL_ORDER = ["null_model", "always_one_model", "always_zero_model", "lasso_logistic", "logistic_regression",
               "random_forest", "xgboost", "neural_network"]


def datasets(modeling: DataFrame, sector: str = "SectorCode", years: dict | None = None) -> dict[str, DataFrame]:
    """All parts for all sectors in one job each; sectors are balanced on their own."""
    parts = temporal_split(modeling, **(years or {}))
    full = parts["train"].unionByName(parts["validation"])
    return {
        **parts,
        "train_full": full,
        "train_balanced": balance_binary(parts["train"], TARGET, per=[sector]),
        "train_full_balanced": balance_binary(full, TARGET, per=[sector]),
    }


def _result(model: str, test: float | None, validation: float | None = None, params: dict | None = None) -> tuple:
    return model, validation, test, {k: str(v) for k, v in (params or {}).items()}


def train_sector(parts: dict[str, DataFrame], features: Sequence[str], c_grid: Sequence[float], forest_grid: Sequence[dict],
                 boost_grid: Sequence[dict], net_grid: Sequence[dict], parallelism: int = 4,
                 keep: Callable[[str, PipelineModel], None] | None = None) -> list[tuple]:
    """Accuracy of every model on one sector's parts: validation picks the point, the final fit uses both years.

    ``keep`` takes the name and the pipeline of every final model; a pipeline runs on the columns of the modeling table as they are.
    """
    features = list(features)
    assert_not_empty(train=parts["train_balanced"], validation=parts["validation"], test=parts["test"])
    held: list[DataFrame] = []

    def prepared(fit_on: str, *names: str, columns: Sequence[str], scaled: bool) -> tuple:
        fitted = M.standardise_fit(parts[fit_on], columns) if scaled else {}
        made = [M.vectors(M.standardise(parts[n], fitted) if scaled else parts[n], columns).cache() for n in names]
        held.extend(made)
        return fitted, *made

    out = []

    def final(name: str, columns: Sequence[str], fitted: dict, model, test: DataFrame, validation: float | None = None, params: dict | None = None) -> None:
        out.append(_result(name, M.accuracy_of(model, test), validation, params))
        if keep is not None:
            keep(name, M.raw_pipeline(columns, fitted, model))

    for kind in BASELINES:
        p = M.baseline(parts["test"], kind, history=parts["train_full"])
        out.append(_result(kind, p.agg(F.avg((F.col(f"`{TARGET}`") == F.col("predicted")).cast("double"))).first()[0]))

    _, train, validation = prepared("train_balanced", "train_balanced", "validation", columns=features, scaled=True)
    n = train.count()
    searched = M.grid_search(train, validation, lambda C: M.l1_logistic(n, C), [{"C": c} for c in c_grid], parallelism)
    best = M.select_candidate(searched.withColumn("C", F.col("params")["C"].cast("double"))).first()
    scale, full, test = prepared("train_full_balanced", "train_full_balanced", "test", columns=features, scaled=True)
    n_full = full.count()
    lasso = M.l1_logistic(n_full, best["C"]).fit(full)
    final("lasso_logistic", features, scale, lasso, test, best["validation_accuracy"], best["params"])
    table = M.coefficient_table(full.sparkSession, features, lasso.coefficients.toArray())
    chosen = [r["feature"] for r in M.selected_variables(table).collect()] if any(lasso.coefficients.toArray()) else features

    chosen_scale, fs, ts = prepared("train_full_balanced", "train_full_balanced", "test", columns=chosen, scaled=True)
    final("logistic_regression", chosen, chosen_scale, M.plain_logistic(n_full).fit(fs), ts)

    _, tr, va = prepared("train_balanced", "train_balanced", "validation", columns=chosen, scaled=False)
    _, fr, tr_test = prepared("train_full_balanced", "train_full_balanced", "test", columns=chosen, scaled=False)
    for name, build, points in (("random_forest", M.forest, forest_grid), ("xgboost", M.boosted, boost_grid)):
        b = M.best_point(M.grid_search(tr, va, build, points, parallelism)).first()
        params = points[b["point"]]
        final(name, chosen, {}, build(**params).fit(fr), tr_test, b["validation_accuracy"], params)

    _, st, sv = prepared("train_balanced", "train_balanced", "validation", columns=chosen, scaled=True)

    def build_net(**point):
        return M.two_layer_net(len(chosen), **point)

    b = M.best_point(M.grid_search(st, sv, build_net, net_grid, parallelism)).first()
    params = net_grid[b["point"]]
    final("neural_network", chosen, chosen_scale, build_net(**params).fit(fs), ts, b["validation_accuracy"], params)
    for df in held:
        df.unpersist()
    return out


def per_sector(sectors: Sequence, job: Callable, threads: int = 2) -> list[tuple]:
    """Run a job for every sector: (sector, result). Only the model fits are looped; they are submitted from a few threads."""
    with ThreadPool(threads) as pool:
        return list(zip(sectors, pool.map(job, list(sectors)), strict=True))


def trainable_sectors(parts: dict[str, DataFrame], sector: str = "SectorCode") -> list:
    """Sectors with both classes to learn from and rows in every part."""
    found = None
    for name in ("train_balanced", "validation", "test"):
        need = 2 if name == "train_balanced" else 1
        s = parts[name].groupBy(sector).agg(F.count_distinct(F.col(f"`{TARGET}`")).alias("n")).filter(F.col("n") >= need).select(sector)
        found = s if found is None else found.intersect(s)
    return [r[0] for r in found.orderBy(sector).collect()]


def train_and_rank(modeling: DataFrame, sectors: Sequence | None, sector: str = "SectorCode", years: dict | None = None,
                   c_grid: Sequence[float] = tuple(M.C_GRID), forest_grid: Sequence[dict] | None = None,
                   boost_grid: Sequence[dict] | None = None, net_grid: Sequence[dict] = ({"hidden1": 32, "hidden2": 16},),
                   threads: int = 2, store: str | None = None) -> DataFrame:
    """One row per sector and model with accuracies and parameters, ranked.

    Without a list all sectors that can be trained are; a listed sector without rows is an error. With ``store``, a folder that all
    executors reach, the fitted pipelines are saved there and ``path`` names them; ``evaluation.best_model_predictions`` loads them.
    """
    whole = datasets(modeling, sector, years)
    frozen = {n: freeze(df) for n, df in whole.items()}
    sectors = trainable_sectors(frozen, sector) if sectors is None else list(sectors)
    features = [c for c in M.feature_columns(modeling) if c != sector]
    forests = list(forest_grid) if forest_grid is not None else M.grid(M.FOREST_GRID)
    boosts = list(boost_grid) if boost_grid is not None else M.grid(M.BOOST_GRID)

    def folder(s, model: str) -> str | None:
        return None if store is None or model in BASELINES else f"{store}/sector={s}/{model}"

    def run(s) -> list[tuple]:
        parts = {n: df.filter(F.col(sector) == s) for n, df in frozen.items()}

        def save(model: str, pipeline: PipelineModel) -> None:
            pipeline.write().overwrite().save(folder(s, model))

        return train_sector(parts, features, c_grid, forests, boosts, list(net_grid), keep=save if store else None)

    rows = [(s, *row, folder(s, row[0])) for s, found in per_sector(sectors, run, threads) for row in found]
    kind = modeling.schema[sector].dataType.simpleString()
    table = modeling.sparkSession.createDataFrame(
        rows, f"sector {kind}, model string, validation_accuracy double, test_accuracy double, params map<string,string>, path string"
    )
    order = F.create_map(*[F.lit(x) for i, m in enumerate(MODEL_ORDER) for x in (m, i)])
    return M.rank_models(table.withColumn("execution_order", F.try_element_at(order, F.col("model"))), order="execution_order")
