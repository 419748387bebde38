"""Terms chosen by their chi-squared against the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.functions.text import ngrams


def chi_squared(docs: DataFrame, label: str = "label") -> DataFrame:
    """``(term, df, chi2)``: chi-squared of a term's presence in a document against the label.

    ``docs`` has a ``terms`` array and a label of any number of classes; rows without a label are left out.
    A term counts once per document, and counts per class are combined before the only shuffle of terms.
    A term of every document has chi-squared 0.
    """
    docs = docs.where(F.col(label).isNotNull())
    classes = sorted(r[0] for r in docs.select(label).distinct().collect())  # a row per class
    sizes = docs.agg(*[F.count_if(F.col(label) == c) for c in classes], F.count("*")).first()
    total = sizes[-1]
    each = docs.select(label, F.explode_outer(F.array_distinct(ngrams(F.col("terms")))).alias("term"))
    counted = each.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count("*").alias("df"), *[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(classes)]
    )

    def cell(found: Column, expected: Column) -> Column:
        return F.when(expected > 0, (found - expected) * (found - expected) / expected).otherwise(F.lit(0.0))

    chi2 = F.lit(0.0)
    for i in range(len(classes)):
        n = F.lit(float(sizes[i]))
        share = n / F.lit(float(total))
        chi2 = chi2 + cell(F.col(f"c{i}"), F.col("df") * share)
        chi2 = chi2 + cell(n - F.col(f"c{i}"), (F.lit(float(total)) - F.col("df")) * share)
    return counted.select("term", "df", chi2.alias("chi2"))


def select_terms(scored: DataFrame, k: int = 1000) -> DataFrame:
    """The ``k`` terms of largest chi-squared (to nine places), the more frequent first among equals, then by name."""
    order = [F.desc(F.round("chi2", 9)), F.desc("df"), F.asc("term")]
    return scored.orderBy(*order).limit(k)
