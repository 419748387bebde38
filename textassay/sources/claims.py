"""CSV sources of labelled claims and enriched posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.labels import strict_label

# Cell texts that count as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The counting columns of an enriched-post CSV; the others are texts.
COUNT_COLUMNS = ("hedge_words_count", "symbols", "all_caps")


def null_if_missing(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def whole_number(c: Column) -> Column:
    """Int of a cell's text, null where it is missing, an error for anything else."""
    number = null_if_missing(c).cast("double")
    whole = F.when(number == F.floor(number), strict_label(number))
    bad = F.raise_error(F.concat(F.lit("not a whole number: "), c)).cast("int")
    return F.when(number.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(whole, bad))


def _csv(spark: SparkSession, path: str, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )


def read_claims(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("claim", "label"),
    multi_line: bool = True,
) -> DataFrame:
    """``(claim, label)`` of a labelled CSV; other columns of the file are ignored.

    Undecodable bytes become U+FFFD, missing-value texts become null, and a
    label that is not a whole number is an error. Quoted newlines need ``multi_line``,
    which makes each file one task: convert once with ``write_claims`` and read
    Parquet from then on.
    """
    raw = _csv(spark, path, multi_line).csv(path)  # all strings, names from the header
    claim, label = columns
    return raw.select(
        null_if_missing(F.col(claim)).alias("claim"), whole_number(F.col(label)).alias("label")
    )


def read_enriched_posts(
    spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True
) -> DataFrame:
    """Named columns of an enriched-post CSV, found by the header and not by position.

    A count that is not a whole number is an error.
    """
    raw = _csv(spark, path, multi_line).csv(path)
    return raw.select(
        *[whole_number(F.col(c)).alias(c) if c in COUNT_COLUMNS else F.col(c) for c in columns]
    )


def write_claims(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The processed ``(claim, label)`` dataset, as Parquet or CSV."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)
