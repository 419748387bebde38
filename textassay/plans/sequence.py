"""Word order as evidence: one interpolated Kneser-Ney model of word pairs per class, and their likelihood ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.functions.text import count_repeats
from textassay.operators.joins import hot_keys, lookup_join
from textassay.session import materialise

EDGE = " "  # stands before the first and behind the last word; no word holds a blank
CLASSES = (0, 1)
FALLBACK = 0.5  # discount where the counts of counts give none


@dataclass(frozen=True)
class PairModel:
    """Tables of counts per class: ``pairs (pair, c0, c1)``, ``contexts (v, n0, t0, n1, t1)``,
    ``endings (w, k0, k1)``; and one row of discounts and totals."""

    pairs: DataFrame
    contexts: DataFrame
    endings: DataFrame
    totals: DataFrame


def word_pairs(words: Column) -> Column:
    """Each word with the one before it, as ``v``, a blank, ``w``; the ends of the text count as words."""
    before = F.concat(F.array(F.lit(EDGE)), words)
    behind = F.concat(words, F.array(F.lit(EDGE)))
    return F.zip_with(before, behind, lambda v, w: F.concat(v, F.lit(" "), w))


def _first(pair: Column) -> Column:
    return F.when(pair.startswith("  "), F.lit(EDGE)).otherwise(F.substring_index(pair, " ", 1))


def _second(pair: Column) -> Column:
    return F.when(pair.endswith("  "), F.lit(EDGE)).otherwise(F.substring_index(pair, " ", -1))


def pair_counts(rows: DataFrame, keep: list[str], words: str = "words") -> DataFrame:
    """``(*keep, pair, n)``, counted inside each row."""
    each = rows.select(*keep, F.inline(count_repeats(word_pairs(F.coalesce(words, F.array().cast("array<string>"))))))
    return each.select(*keep, F.col("term").alias("pair"), F.col("tf").alias("n"))


def fit_pair_model(train: DataFrame, label: str = "label", words: str = "words") -> PairModel:
    """Counts of the training rows (``words``, ``label`` 0 or 1). Everything but the totals stays a table.

    A discount is n1 / (n1 + 2 n2), n1 and n2 being how many pairs (for the lower order, words) were counted once
    and twice in the class; a half where there is neither.
    """
    counted = pair_counts(train, [label], words).groupBy("pair").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in CLASSES]
    )
    pairs = materialise(counted, "pairs")
    seen = lambda c: F.count_if(F.col(f"c{c}") > 0)
    contexts = pairs.groupBy(_first(F.col("pair")).alias("v")).agg(
        *[a for c in CLASSES for a in (F.sum(f"c{c}").alias(f"n{c}"), seen(c).alias(f"t{c}"))]
    )
    endings = pairs.groupBy(_second(F.col("pair")).alias("w")).agg(*[seen(c).alias(f"k{c}") for c in CLASSES])
    contexts, endings = materialise(contexts, "contexts"), materialise(endings, "endings")

    def discount(column: str) -> Column:
        once, twice = F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)
        return F.coalesce(F.try_divide(once.cast("double"), (once + 2 * twice).cast("double")), F.lit(0.0))

    positive = lambda x: F.when(x > 0, x).otherwise(F.lit(FALLBACK))
    upper = pairs.agg(*[positive(discount(f"c{c}")).alias(f"d{c}") for c in CLASSES])
    lower = endings.agg(
        (F.count("*") + 1).alias("words"),
        *[
            a
            for c in CLASSES
            for a in (
                positive(discount(f"k{c}")).alias(f"e{c}"),
                F.coalesce(F.sum(f"k{c}"), F.lit(0)).alias(f"s{c}"),
                F.count_if(F.col(f"k{c}") > 0).alias(f"u{c}"),
            )
        ],
    )
    values = {**upper.first().asDict(), **lower.first().asDict()}
    totals = train.sparkSession.createDataFrame([tuple(float(v) for v in values.values())], " double, ".join(values) + " double")
    return PairModel(pairs, contexts, endings, materialise(totals, "pair_totals"))


def log_likelihood(c: int, totals: dict[str, float]) -> Column:
    """Log probability of ``w`` after ``v`` in class ``c``, from the joined counts.

    What the discount takes from the pairs after ``v`` goes to ``w`` by the number of words it follows,
    and what that discounts to all words alike, an unknown one among them.
    """
    even = 1.0 / totals["words"]
    count = lambda name: F.coalesce(F.col(f"{name}{c}"), F.lit(0)).cast("double")
    d, e, s, u = (totals[f"{name}{c}"] for name in "desu")
    lower = F.greatest(count("k") - e, F.lit(0.0)) / s + F.lit(e * u / s * even) if s else F.lit(even)
    upper = (F.greatest(count("c") - d, F.lit(0.0)) + d * count("t") * lower) / count("n")
    return F.log(F.when(count("n") > 0, upper).otherwise(lower))


def score_pairs(rows: DataFrame, model: PairModel, keep: list[str], words: str = "words", key: str = "doc_id") -> DataFrame:
    """``(key, *keep, n_pairs, llr, prob, prediction)`` for every row, also without words.

    ``llr`` is the log likelihood of the row in class 1 less that in class 0, both classes alike beforehand;
    ``prob`` the logistic of its mean per pair, which orders texts of different length.
    """
    totals = model.totals.first().asDict()
    each = pair_counts(rows, [key, *keep], words)
    heavy = lambda t, name, weight: hot_keys(t.withColumn("_weight", weight), name, "_weight")
    both = lambda name: F.col(f"{name}0") + F.col(f"{name}1")
    each = lookup_join(each, model.pairs, "pair", key, "left", heavy(model.pairs, "pair", both("c")))
    # the words of a pair are cut out behind the join, which would shuffle them beside it
    each = each.withColumns({"v": _first(F.col("pair")), "w": _second(F.col("pair"))}).drop("pair")
    for table, name, weight in ((model.contexts, "v", both("n")), (model.endings, "w", both("k"))):
        each = lookup_join(each, table, name, key, "left", heavy(table, name, weight))
    ratio = log_likelihood(1, totals) - log_likelihood(0, totals)
    summed = each.groupBy(key, *keep).agg(
        F.sum("n").alias("n_pairs"), F.sum(F.col("n") * ratio).alias("llr")
    )
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("llr") / F.col("n_pairs")))
    return summed.withColumn("prob", prob).withColumn("prediction", (F.col("llr") > 0).cast("int"))
