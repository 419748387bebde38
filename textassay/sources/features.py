"""Feature tables, one Parquet partition per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.operators.splits import SPLITS
from textassay.session import cleaned_shuffles


def write_features(df: DataFrame, path: str) -> None:
    """Features with their label, partitioned by ``split``.

    The label is a column of the same row; there is no second file to align.
    """
    with cleaned_shuffles(df.sparkSession):
        df.write.mode("overwrite").partitionBy("split").parquet(path, compression="zstd")


def load_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One split (other partitions are not listed or read), or all of them."""
    table = spark.read.parquet(path)
    if split is None:
        return table
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}: choose one of {SPLITS}")
    return table.where(F.col("split") == split)


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows of one feature table."""
    train, val, test = (load_features(spark, path, s) for s in SPLITS)
    return train, val, test
