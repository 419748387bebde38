"""Counts and quality measures of hard predictions.

Everything is computed from one aggregation of the rows; what follows works on
as many rows as there are classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, 0 where the denominator is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_class)``; weight 1 with a single class."""
    whole = Window.partitionBy(F.lit(0))  # over one row per class
    n, total, k = F.col("n"), F.sum("n").over(whole), F.count("*").over(whole)
    return class_counts(df, [label]).select(
        label, F.when(k > 1, total / (k * n)).otherwise(F.lit(1.0)).alias("weight")
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """Long form ``(label, prediction, n)`` over the whole class grid.

    One aggregation with a conditional count per cell, so that cells without
    rows are there with 0.
    """
    cells = [
        F.struct(
            F.lit(a).alias("label"),
            F.lit(p).alias("prediction"),
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).alias("n"),
        )
        for a in classes
        for p in classes
    ]
    grid = df.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return grid.select(*by, F.inline("cells"))


def normalised_confusion(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each cell in its row (actual class)."""
    rows = F.sum("n").over(Window.partitionBy(*by, "label"))
    return matrix.select(*by, "label", "prediction", ratio(F.col("n"), rows).alias("share"))


def binary_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, score and accuracy, precision, recall, F1 of class 1."""
    y, p = F.col("label"), F.col("prediction")
    counted = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(y == p).alias("correct"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        *by,
        "total",
        "correct",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(df: DataFrame) -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class, then the averages.

    The rows are counted once per (label, prediction); everything after works on
    at most classes x classes rows.
    """
    cells = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    per_class = (
        cells.select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("label").alias("class"),
                        F.col("n").alias("actual"),
                        F.lit(0).cast("long").alias("predicted"),
                        F.when(F.col("label") == F.col("prediction"), F.col("n"))
                        .otherwise(0)
                        .alias("hit"),
                    ),
                    F.struct(
                        F.col("prediction").alias("class"),
                        F.lit(0).cast("long").alias("actual"),
                        F.col("n").alias("predicted"),
                        F.lit(0).cast("long").alias("hit"),
                    ),
                )
            ).alias("c")
        )
        .select("c.*")
        .groupBy("class")
        .agg(
            F.sum("actual").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hit").alias("hit"),
        )
        .select(
            F.col("class").cast("string").alias("class"),
            ratio(F.col("hit"), F.col("predicted")).alias("precision"),
            ratio(F.col("hit"), F.col("support")).alias("recall"),
            ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
            "support",
            "hit",
        )
    )
    measures = ["precision", "recall", "f1"]
    n = F.sum("support")
    share = F.sum("hit") / n
    averages = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                *[share.alias(m) for m in measures],
                n.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(m).alias(m) for m in measures],
                n.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in measures],
                n.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("hit").unionByName(averages)


def rmse_column(prob: Column, label: str = "label") -> Column:
    return F.sqrt(F.avg(F.pow(prob - F.col(label), F.lit(2.0))))


def rmse(df: DataFrame, prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(rmse_column(F.col(prob)).alias("rmse"))


def fold_summary(scores: DataFrame, by: str = "step", value: str = "f1") -> DataFrame:
    """Mean and population standard deviation of the fold scores."""
    return scores.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
