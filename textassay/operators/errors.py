"""Which rows a classifier gets wrong, and what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.labels import excerpt
from textassay.functions.text import words
from textassay.operators.joins import attach_text
from textassay.operators.metrics import ratio
from textassay.operators.ordered import top_k
from textassay.session import materialise


def false_positives(df: DataFrame) -> DataFrame:
    return df.where("label = 0 AND prediction = 1").withColumn("error_type", F.lit("FP"))


def false_negatives(df: DataFrame) -> DataFrame:
    return df.where("label = 1 AND prediction = 0").withColumn("error_type", F.lit("FN"))


def misclassified(df: DataFrame) -> DataFrame:
    """False positives and false negatives, tagged; one pass over ``df``."""
    kind = F.when(F.col("prediction") == 1, "FP").otherwise("FN")
    wrong = "(label = 0 AND prediction = 1) OR (label = 1 AND prediction = 0)"
    return df.where(wrong).withColumn("error_type", kind)


def error_summary(df: DataFrame) -> DataFrame:
    counted = df.agg(
        F.count("*").alias("total"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("fp"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"),
        F.count_if(F.col("label") == F.col("prediction")).alias("correct"),
    )
    total = F.col("total")
    return counted.select(
        "total",
        "fp",
        "fn",
        ratio(F.col("fp"), total).alias("fp_share"),
        ratio(F.col("fn"), total).alias("fn_share"),
        ratio(F.col("correct"), total).alias("accuracy"),
    )


def error_words(errors: DataFrame, k: int = 15) -> DataFrame:
    """Most frequent raw words of each error type: ``(error_type, rank, word, n)``."""
    counted = (
        errors.select("error_type", F.explode_outer(words(F.lower("text"))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("error_type", "word")
        .agg(F.count("*").alias("n"))
    )
    return top_k(counted, k, [F.desc("n"), F.asc("word")], ["error_type"]).select(
        "error_type", "rank", "word", "n"
    )


def error_examples(
    errors: DataFrame, documents: DataFrame, n: int = 10, key: str = "doc_id"
) -> DataFrame:
    """The first ``n`` rows of each error type, with a 200-character excerpt.

    The rows are chosen before any text is read: ``2 * n`` of them are stored
    and meet the documents in a broadcast join.
    """
    first = top_k(errors.select("error_type", key, "prob"), n, [F.asc(key)], ["error_type"])
    chosen = materialise(first, "examples")
    return attach_text(chosen, documents, key).select(
        "error_type", "rank", key, "prob", excerpt(F.col("text")).alias("excerpt")
    )
