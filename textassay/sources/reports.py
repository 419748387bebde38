"""Sinks for error rows and small JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_misclassified(errors: DataFrame, path: str) -> None:
    """Claim, true label, predicted label and probability of each wrong row."""
    errors.select(
        F.col("text").alias("claim"),
        F.col("label").alias("true_label"),
        F.col("prediction").alias("pred_label"),
        F.col("prob").alias("pred_prob"),
    ).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON line."""
    report.write.mode("overwrite").json(path)


def training_history(spark: SparkSession, model) -> DataFrame:
    """``(iteration, objective)`` of a fitted logistic regression.

    The history is in the model's summary: it is there right after the fit, and
    not after the model has been loaded again.
    """
    rows = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, objective double")
