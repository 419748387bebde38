"""Alignment by key, and a join that survives very frequent keys.

Rows are aligned on ``doc_id`` everywhere; nothing depends on row positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.session import is_small, materialise, shuffle_partitions


def attach_labels(
    documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id"
) -> DataFrame:
    """Labelled text ``(doc_id, text, label)``; rows without text or label drop out."""
    right = labels.select(key, F.col(label).alias("label")).where(F.col("label").isNotNull())
    left = documents.select(key, "text").where(F.col("text").isNotNull())
    return left.join(right, key)


def attach_measure(
    documents: DataFrame, labels: DataFrame, measure: Column, label: str = "quality", key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, measure, label)`` of the labelled texts, without sending a text through a shuffle.

    Few labels are broadcast to the texts, and only labelled texts are measured. Where
    there are too many, every text is measured where it is read and the measure is joined.
    """
    right = labels.select(key, F.col(label).alias("label")).where(F.col("label").isNotNull())
    left = documents.select(key, "text").where(F.col("text").isNotNull())
    if is_small(right):
        return left.join(F.broadcast(right), key).select(key, measure.alias("measure"), "label")
    return left.select(key, measure.alias("measure")).join(right.hint("merge"), key)


def attach_text(predictions: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return predictions.join(documents.select(key, "text"), key)


def hot_keys(
    counts: DataFrame, key: str, weight: str, limit: int | None = None
) -> DataFrame | None:
    """Keys too frequent for one task, with the number of salts each one needs.

    A key is hot when its weight exceeds ``limit``, by default a quarter of an
    average partition and at least a million rows. There are then at most
    ``4 * partitions`` hot keys and ``8 * partitions`` salted copies, whatever
    the data. ``None`` when there are no such keys.
    """
    found = counts.agg(F.sum(weight).cast("long").alias("total"), F.max(weight).alias("top")).first()
    if limit is None:
        parts = shuffle_partitions(counts.sparkSession)
        limit = max(1_000_000, (found["total"] or 0) // (4 * parts))
    if (found["top"] or 0) <= limit:
        return None
    salts = F.ceil(F.col(weight) / limit).cast("int")
    return materialise(
        counts.where(F.col(weight) > limit).select(key, salts.alias("_salts")), "hot_keys"
    )


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_on: str,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a stored table that is unique on ``key``.

    A table small enough is broadcast, see :func:`textassay.session.is_small`, whatever its
    keys: nothing is shuffled then. A larger one is sort-merge joined; with
    ``hot`` (see :func:`hot_keys`) the rows of a hot key are spread over
    its salts by the hash of ``spread_on``, and only the hot entries of
    ``table`` are repeated once per salt. All other keys keep salt 0.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), key, how)
    if hot is None:
        return rows.join(table.hint("merge"), key, how)
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_on), salts).cast("int")
    )
    right = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    right = right.drop("_salts").hint("merge")
    return left.drop("_salts").join(right, [key, "_salt"], how).drop("_salt")
