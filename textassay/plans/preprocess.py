"""Labelled text to padded index sequences, with the run report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.labels import positive_is_one, strict_label
from textassay.functions.text import clean_text, repair_text, sequence_words
from textassay.operators import vocab
from textassay.operators.splits import SPLITS, stratified_split
from textassay.session import materialise


@dataclass(frozen=True)
class Preprocessed:
    sequences: DataFrame  # (doc_id, split, label, seq)
    vocabulary: DataFrame  # (word, n, idx)
    report: DataFrame  # one row


def prepare(df: DataFrame, positive_value: int = 1, repair: bool = True) -> DataFrame:
    """``(doc_id, label, words)``; ``words`` is null for a row without text or label.

    Rows are only marked here, so that the report can count them.
    """
    text = repair_text(F.col("text")) if repair else F.col("text")
    complete = F.col("text").isNotNull() & F.col("label").isNotNull()
    label = positive_is_one(strict_label(F.col("label")), positive_value)
    words = sequence_words(clean_text(text))
    return df.select("doc_id", label.alias("label"), F.when(complete, words).alias("words"))


def preprocess(
    df: DataFrame,
    maxlen: int = 273,
    positive_value: int = 1,
    seed: int = 42,
    repair: bool = True,
    source: str = "",
) -> Preprocessed:
    """``df`` has ``doc_id, text, label``; the vocabulary sees the training split only."""
    marked = materialise(prepare(df, positive_value, repair), "prepared")
    used = marked.where(F.size("words") > 0)
    rows = materialise(stratified_split(used, seed=seed), "split_words")
    vocabulary = vocab.build_vocabulary(rows.where("split = 'train'"))
    vocabulary = vocab.store_vocabulary(vocabulary)
    sequences = vocab.encode_padded(rows, vocabulary, maxlen, keep=("split", "label"))
    return Preprocessed(sequences, vocabulary, run_report(marked, rows, vocabulary, maxlen, source))


def run_report(
    marked: DataFrame, rows: DataFrame, vocabulary: DataFrame, maxlen: int, source: str = ""
) -> DataFrame:
    """Rows read, used and dropped (missing ones too), vocabulary, classes per split."""
    per_class = rows.groupBy("split", "label").agg(F.count("*").alias("n"))

    def of(split: str):
        here = F.col("split") == split
        entries = F.collect_list(F.when(here, F.struct(F.col("label").cast("string"), "n")))
        return F.struct(
            F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("n"),
            F.map_from_entries(F.array_sort(entries)).alias("classes"),
        ).alias(split)

    splits = per_class.agg(F.struct(*[of(s) for s in SPLITS]).alias("splits"))
    used = F.coalesce(F.col("words").isNotNull() & (F.size("words") > 0), F.lit(False))
    counts = marked.agg(
        F.count("*").alias("rows_total"),
        F.count_if(used).alias("rows_used"),
        F.count_if(~used).alias("rows_dropped"),
    )
    return counts.select(
        F.lit(source).alias("csv"),
        F.lit(maxlen).alias("maxlen"),
        vocab.vocabulary_size(vocabulary).scalar().alias("vocab_size"),
        "rows_total",
        "rows_used",
        "rows_dropped",
        splits.scalar().alias("splits"),
    )
