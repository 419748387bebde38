"""Word counts, vocabularies and index sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.text import pad_sequence
from textassay.operators.joins import hot_keys, lookup_join
from textassay.operators.ordered import ordered_index
from textassay.session import materialise

OOV, FIRST_INDEX = 1, 2  # 0 is padding


def word_counts(df: DataFrame, words: str = "words") -> DataFrame:
    # The outer explode keeps Catalyst from adding a size(words) > 0 filter, which
    # would compute the words of every row a second time.
    exploded = df.select(F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    return exploded.groupBy("word").agg(F.count("*").alias("n"))


def build_vocabulary(df: DataFrame, words: str = "words") -> DataFrame:
    """``(word, n, idx)``: most frequent first, ties by word, from index 2."""
    order = [F.desc("n"), F.asc("word")]
    return ordered_index(word_counts(df, words), order, "idx", FIRST_INDEX)


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    """One row ``vocab_size``: words, the out-of-vocabulary entry and padding."""
    return vocabulary.agg((F.count("*") + 2).alias("vocab_size"))


def word_indices(
    df: DataFrame, vocabulary: DataFrame, words: str = "words", key: str = "doc_id",
    hot_limit: int | None = None,
) -> DataFrame:
    """``(key, pos, word, idx)``; a word outside the vocabulary gets index 1."""
    exploded = df.select(key, F.posexplode_outer(words).alias("pos", "word"))
    exploded = exploded.where(F.col("word").isNotNull())
    hot = hot_keys(vocabulary, "word", "n", limit=hot_limit)
    table = vocabulary.select("word", F.col("idx").cast("int").alias("idx"))
    found = lookup_join(exploded, table, "word", key, "left", hot)
    return found.select(key, "pos", "word", F.coalesce("idx", F.lit(OOV)).alias("idx"))


def encode(
    df: DataFrame, vocabulary: DataFrame, words: str = "words", key: str = "doc_id",
    hot_limit: int | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, *keep, seq)`` for every row of ``df``; no words gives an empty array.

    Narrow columns that the result needs travel with the words as ``keep``, and a row without words as a
    place without a word, so nothing is joined back after the grouping.
    """
    exploded = df.select(key, *keep, F.posexplode_outer(words).alias("pos", "word"))
    # a place of its own for each row without words: null keys would all meet in one task
    nothing = F.concat(F.lit("\x00"), F.col(key).cast("string"))
    looked_up = exploded.withColumns(
        {"_is_word": F.col("word").isNotNull(), "word": F.coalesce("word", nothing, F.lit("\x00"))}
    )
    hot = hot_keys(vocabulary, "word", "n", limit=hot_limit)
    table = vocabulary.select("word", F.col("idx").cast("int").alias("idx"))
    found = lookup_join(looked_up, table, "word", key, "left", hot)
    place = F.when(F.col("_is_word"), F.struct("pos", F.coalesce("idx", F.lit(OOV)).alias("idx")))
    pairs = F.array_sort(F.collect_list(place))
    return found.groupBy(key, *keep).agg(F.transform(pairs, lambda p: p["idx"]).alias("seq"))


def encode_padded(
    df: DataFrame, vocabulary: DataFrame, maxlen: int, words: str = "words", key: str = "doc_id",
    hot_limit: int | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, *keep, seq)`` cut or zero-filled at the end to ``maxlen``.

    Positions past ``maxlen`` can not reach the result, so they are removed
    before the words are joined rather than after.
    """
    kept = df.select(key, *keep, F.slice(words, 1, maxlen).alias(words))
    seqs = encode(kept, vocabulary, words, key, hot_limit, keep)
    return seqs.select(key, *keep, pad_sequence(F.col("seq"), maxlen).alias("seq"))


def store_vocabulary(vocabulary: DataFrame) -> DataFrame:
    return materialise(vocabulary, "vocabulary")
