"""A training corpus from the documents table, in five stages.

Each stage takes the documents that the one before kept, and its result is
written and read again before the next one starts, so a lost executor or a failed stage
never sends the work back to the beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.llm import boilerplate, language, pii, simhash
from textassay.llm.queries import held_out, packed
from textassay.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    learned = language.sample_languages(docs.where(F.coalesce(~held_out(), F.lit(False))))
    found = language.identify(docs, learned)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sites' boilerplate lines."""
    return _measured(boilerplate.drop_boilerplate(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash, linked at 4 or fewer differing bits, the smallest id."""
    return simhash.keep_representatives(docs, width=4, distance=4).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of personal data in place of the data."""
    found = materialise(pii.add_candidates(docs), "with_candidates")
    model = pii.fit(found)
    return _measured(found.withColumn("text", pii.redacted(F.col("text"), pii.accepted(model))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in windows."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has no words for suffix automata, linked groups, fitted span models or a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
