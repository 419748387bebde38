"""Evaluation of scored rows and of fitted models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.labels import decide
from textassay.operators import curves, metrics
from textassay.session import materialise


def score(model, df: DataFrame, keep: tuple[str, ...] = ("doc_id", "label")) -> DataFrame:
    """``keep`` columns with the predicted class and P(class 1)."""
    out = model.transform(df)
    return out.select(
        *keep,
        vector_to_array("probability")[1].alias("prob"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def evaluate_scores(df: DataFrame) -> DataFrame:
    """One row ``accuracy, auc, average_precision`` from one pass over the rows."""
    counted = df.groupBy("prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
        F.count_if(F.col("label") == F.col("prediction")).alias("hit"),
    )
    totals = curves.totals_of(counted, ["hit"])
    accuracy = metrics.ratio(F.sum("hit"), F.sum(F.col("pos") + F.col("neg")))
    return totals.agg(accuracy.alias("accuracy"), *curves.quality_columns())


def evaluate_model(model, df: DataFrame) -> DataFrame:
    return evaluate_scores(score(model, df))


def final_test(val: DataFrame, test: DataFrame) -> DataFrame:
    """Threshold with the best F1 on validation scores, applied to test scores."""
    best = materialise(
        curves.best_threshold(curves.pr_points(curves.score_totals(val))), "best_threshold"
    ).select("threshold", F.col("f1").alias("val_best_f1"))
    threshold = best.first()["threshold"]
    decided = test.withColumn("prediction", decide(F.col("prob"), threshold))
    measured = evaluate_scores(decided).select(
        F.col("auc").alias("test_auc"), F.col("accuracy").alias("test_accuracy")
    )
    return measured.withColumns(
        {
            "val_threshold": best.select("threshold").scalar(),
            "val_best_f1": best.select("val_best_f1").scalar(),
        }
    )
