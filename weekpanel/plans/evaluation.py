"""Predictions of the stored best models and their summary over all sectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import TARGET
from weekpanel.operators.aggregates import accuracy
from weekpanel.operators.models import best_vs_baselines, predict_with_confidence
from weekpanel.operators.sets import union_all
from weekpanel.session import shared_dir
from weekpanel.sources.upsert import fresh_path

KEYS = ("Ticker", "WeekEndingFriday")


def best_model_predictions(test: DataFrame, results: DataFrame, sector: str = "SectorCode", target: str = TARGET,
                           select_by: str | None = None) -> DataFrame:
    """Predicted class and its probability of every row of ``test``, by the best stored model of the row's sector.

    ``results`` is the table of ``train_and_rank`` with a store. Only the best model of each sector is loaded. The rows are laid out by
    sector once, so each model reads its own part and together they read every row once. Rows of sectors without a stored model
    are left out; without any the result is empty.
    """
    spark = test.sparkSession
    best = best_vs_baselines(results, order="execution_order", select_by=select_by).select("sector", F.col("best_model").alias("model"))
    chosen = results.join(best, ["sector", "model"]).where("path is not null").orderBy("sector").collect()  # a row for each sector
    if not chosen:  # no sector could be trained
        none = {"label": "int", "predicted": "int", "predicted_probability": "double"}
        return test.limit(0).select(*KEYS, *[F.lit(None).cast(k).alias(c) for c, k in none.items()], F.col(sector).alias("sector"), F.lit("").alias("best_model"))
    path = fresh_path(shared_dir(spark))
    test.withColumn("_sector", F.col(sector)).hint("rebalance", "_sector").write.partitionBy("_sector").parquet(path)
    stored = spark.read.schema(test.withColumn("_sector", F.col(sector)).schema).parquet(path)
    out = []
    for r in chosen:
        rows = stored.filter(F.col("_sector") == r["sector"]).withColumn("label", F.col(f"`{target}`").cast("double"))
        rows = predict_with_confidence(PipelineModel.load(r["path"]), rows, KEYS)
        out.append(rows.withColumns({"sector": F.lit(r["sector"]), "best_model": F.lit(r["model"])}))
    return union_all(*out)


def summaries(results: DataFrame, select_by: str | None = None) -> DataFrame:
    """Best model per sector against the baselines, one table for all sectors."""
    return best_vs_baselines(results, order="execution_order", select_by=select_by).orderBy("sector")


def check_summary(predictions: DataFrame, summary: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sectors whose recomputed accuracy differs from the summary."""
    again = accuracy(predictions, "label", "predicted", ["sector"])
    return again.join(summary.select("sector", "test_accuracy"), "sector").filter(
        F.abs(F.col("accuracy") - F.col("test_accuracy")) > tolerance
    )


def evaluate(modeling_test: DataFrame, results: DataFrame, sector: str = "SectorCode", select_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and summary of the best models; a summary that the predictions do not bear out is an error."""
    predictions = best_model_predictions(modeling_test, results, sector, select_by=select_by)
    summary = summaries(results, select_by)
    wrong = check_summary(predictions, summary).collect()  # a row for each sector at most
    if wrong:
        raise ValueError(f"accuracies differ from the summary: {wrong}")
    return predictions, summary
