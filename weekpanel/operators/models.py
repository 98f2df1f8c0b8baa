"""Classifiers of the modeling table on MLlib, and the tables around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.contracts import BASELINES, NEXT_PRICE, TARGET
from weekpanel.operators.aggregates import mode_of, moments

# Search grids.
C_GRID = [
    1, 0.3, 0.1, 0.05, 0.03, 0.02, 0.015, 0.01, 0.007, 0.005, 0.003, 0.002, 0.001, 0.0007, 0.0005, 0.0003, 0.0001,
]
FOREST_GRID = {"numTrees": [200, 300], "maxDepth": [3, 4, 5], "minInstancesPerNode": [10, 20, 30]}
BOOST_GRID = {
    "maxIter": [75, 100], "stepSize": [0.004, 0.007], "maxDepth": [5, 8], "minInstancesPerNode": [5, 6, 7],
    "subsamplingRate": [0.1, 0.3, 0.5], "featureSubsetStrategy": ["0.7", "1.0"],
}


def grid(options: dict) -> list[dict]:
    return [dict(zip(options, values)) for values in product(*options.values())]


def feature_columns(df: DataFrame, target: str = TARGET, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the keys, the target, the next price and the emotion and polarity scores."""
    gone = {target, "WeekEndingFriday", "Ticker", NEXT_PRICE, *exclude}
    return [c for c in df.columns if c not in gone and "EMO" not in c and "TEXTBLOB" not in c]


def standardise_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (one small row per column reaches the driver)."""
    return {r["column"]: (r["mean"] or 0.0, r["std"] or 0.0) for r in moments(df, columns).collect()}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / std``; a column without spread is only centred."""
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in fitted.items()})


def vectors(df: DataFrame, columns: Sequence[str], target: str = TARGET, keep: Sequence[str] = ()) -> DataFrame:
    """``label`` and ``features``, with columns renamed on the way (MLlib reads dots as struct fields)."""
    names = [f"x{i}" for i in range(len(columns))]
    flat = df.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{target}`").cast("double").alias("label"),
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)],
    )
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).drop(*names)


def raw_pipeline(columns: Sequence[str], fitted: dict[str, tuple[float, float]], model) -> PipelineModel:
    """A fitted model behind the steps that lead from plain columns to its vectors; it can be saved, loaded and run anywhere.

    ``fitted`` are the means and deviations of ``standardise_fit``, none for models that take the columns as they are.
    """
    def scaled(c: str) -> str:
        name = f"cast(`{c.replace('`', '``')}` as double)"
        m, s = fitted.get(c, (0.0, 1.0))
        return f"({name} - ({m!r}D)) / ({s or 1.0!r}D)" if fitted else name

    names = [f"_x{i}" for i in range(len(columns))]
    flat = SQLTransformer(statement=f"SELECT *, {', '.join(f'{scaled(c)} AS {n}' for c, n in zip(columns, names))} FROM __THIS__")
    return PipelineModel([flat, VectorAssembler(inputCols=names, outputCol="features"), model])


def accuracy_of(model, data: DataFrame) -> float:
    return model.transform(data).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def l1_logistic(n_rows: int, c: float) -> LogisticRegression:
    """Lasso logistic regression; the penalty weight 1/C is per row here. Features come standardised."""
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n_rows), standardization=False, maxIter=100, tol=1e-6)


def plain_logistic(n_rows: int) -> LogisticRegression:
    return LogisticRegression(elasticNetParam=0.0, regParam=1.0 / n_rows, standardization=False, maxIter=100, tol=1e-6)


def forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(seed=42, **{"featureSubsetStrategy": "sqrt", **params})


def boosted(**params) -> GBTClassifier:
    return GBTClassifier(seed=42, **params)


def two_layer_net(n_features: int, hidden1: int, hidden2: int, max_iter: int = 200) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_features, hidden1, hidden2, 2], seed=42, maxIter=max_iter)


def grid_search(train: DataFrame, validation: DataFrame, build: Callable[..., object], points: Sequence[dict],
                parallelism: int = 4) -> DataFrame:
    """Fit every grid point on train, score on validation. One row per point, in grid order.

    The points are model fits, not data: the loop submits Spark jobs from a few threads.
    """
    spark = train.sparkSession

    def run(item):
        i, params = item
        model = build(**params).fit(train)
        weights = getattr(model, "coefficients", None) if not hasattr(model, "trees") else None
        nnz = int((weights.toArray() != 0).sum()) if weights is not None and hasattr(weights, "toArray") else None
        return i, {k: str(v) for k, v in params.items()}, float(accuracy_of(model, validation)), nnz

    with ThreadPool(parallelism) as pool:
        rows = pool.map(run, list(enumerate(points)))
    return spark.createDataFrame(rows, "point int, params map<string,string>, validation_accuracy double, n_coefficients int")


def best_point(results: DataFrame) -> DataFrame:
    """Highest accuracy; the first point in grid order keeps a tie."""
    return results.orderBy(F.desc("validation_accuracy"), F.asc("point")).limit(1)


def select_candidate(results: DataFrame, c: str | Column = "C") -> DataFrame:
    """Prefer a model with a coefficient left, then accuracy, then fewer coefficients, then smaller C."""
    return results.orderBy(
        (F.col("n_coefficients") > 0).desc(), F.desc("validation_accuracy"), F.asc("n_coefficients"), F.asc(c)
    ).limit(1)


def coefficient_table(spark, names: Sequence[str], coefficients) -> DataFrame:
    """One row per feature, largest absolute value first."""
    rows = [(n, float(v)) for n, v in zip(names, coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(
        F.abs("coefficient").desc(), F.asc("feature")
    )


def selected_variables(table: DataFrame, k: int | None = None) -> DataFrame:
    """Non-zero coefficients by absolute value, or the top k; nothing selected is an error."""
    kept = table.filter(F.col("coefficient") != 0).orderBy(F.abs("coefficient").desc(), F.asc("feature"))
    if kept.isEmpty():
        raise ValueError("no variable selected")
    return kept.limit(k) if k else kept


def baseline(test: DataFrame, kind: str, target: str = TARGET, history: DataFrame | None = None) -> DataFrame:
    """Predictions of a constant: always 0, always 1, or the most frequent class of the unbalanced history."""
    if kind == "null_model":
        value = mode_of(history, target).select(F.col(f"`{target}`")).scalar()
    elif kind in ("always_one_model", "always_zero_model"):
        value = F.lit(1 if kind == "always_one_model" else 0)
    else:
        raise ValueError(kind)
    return test.withColumn("predicted", value)


def predict_with_confidence(model, data: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keys, label, predicted class and the probability of that class."""
    return model.transform(data).select(
        *[F.col(f"`{c}`") for c in keep], F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("predicted"),
        F.array_max(vector_to_array("probability")).alias("predicted_probability"),
    )


def rank_models(results: DataFrame, sector: str = "sector", measure: str = "test_accuracy", order: str = "model") -> DataFrame:
    """Position and tie rank of the models of every sector, with a flag for the best and all tied with it."""
    w = Window.partitionBy(sector).orderBy(F.desc(measure))
    return results.withColumn("rank", F.rank().over(w)).withColumn(
        "position", F.row_number().over(Window.partitionBy(sector).orderBy(F.desc(measure), F.asc(order)))
    ).withColumn("is_best", (F.col("rank") == 1).cast("int"))


def best_vs_baselines(results: DataFrame, sector: str = "sector", measure: str = "test_accuracy",
                      baselines: Sequence[str] = tuple(BASELINES), order: str = "model",
                      select_by: str | None = None) -> DataFrame:
    """Best model per sector without the baselines, and its lead over each baseline. One aggregate."""
    null, one, zero = baselines
    by = select_by or measure
    real = ~F.col("model").isin(list(baselines)) & F.col(by).isNotNull()
    best = F.min(F.when(real, F.struct((-F.col(by)).alias("m"), F.col(order).alias("o"), F.col("model").alias("model"),
                                       F.col(measure).alias("acc"))))
    level = {n: F.max(F.when(F.col("model") == b, F.col(measure))) for n, b in
             (("null_model", null), ("always_one", one), ("always_zero", zero))}
    agg = results.groupBy(sector).agg(best.alias("_b"), *[v.alias(f"_{n}") for n, v in level.items()])
    return agg.select(
        sector, F.col("_b.model").alias("best_model"), F.col("_b.acc").alias(measure),
        *[(F.col("_b.acc") - F.col(f"_{n}")).alias(f"delta_{n}") for n in level],
    )


def cv_summary(results: DataFrame, params: Sequence[str], measure: str = "accuracy") -> DataFrame:
    """Mean and population deviation of the fold scores per grid point, and the error."""
    return results.groupBy(*params).agg(
        F.avg(measure).alias("mean_accuracy"), F.stddev_pop(measure).alias("std_accuracy"),
        (F.lit(1.0) - F.avg(measure)).alias("mean_error"),
    )
