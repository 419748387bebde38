"""Scalar functions on labels, scores and example text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_label(c: Column) -> Column:
    """Cast to int; under ANSI mode (the Spark 4 default) a bad value throws."""
    return c.cast("int")


def flip_label(c: Column) -> Column:
    return F.lit(1) - c


def positive_is_one(c: Column, positive_value: int = 1) -> Column:
    """Apply label polarity once, at ingestion: the positive class becomes 1."""
    return c if positive_value == 1 else flip_label(c)


def label_name(c: Column, positive: str = "Misinformation", negative: str = "True") -> Column:
    return F.when(c == 1, F.lit(positive)).otherwise(F.lit(negative))


def label_order(c: Column) -> Column:
    """Display order of the classes: the positive class comes first."""
    return F.when(c == 1, F.lit(0)).otherwise(F.lit(1))


def decide(prob: Column, threshold: float | Column = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def excerpt(c: Column, length: int = 200) -> Column:
    return F.substring(c, 1, length)
