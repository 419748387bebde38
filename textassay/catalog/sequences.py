"""The order-aware classifier: counts, discounts, scores and their quality, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textassay.catalog.base import SPLIT, cleaned_sequence_sql, query, split_labelled
from textassay.operators import curves
from textassay.plans import classifiers, evaluation, sequence
from textassay.session import materialise

PAIRS = f"""{SPLIT},
sequences AS (
  SELECT doc_id, split, label, {cleaned_sequence_sql("text")} AS words FROM split),
tokens AS (
  SELECT doc_id, split, label, unnest(list_concat([' '], words)) AS v,
    unnest(list_concat(words, [' '])) AS w FROM sequences),
pairs AS (
  SELECT v, w, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1
  FROM tokens WHERE split = 'train' GROUP BY v, w),
contexts AS (
  SELECT v, sum(c0) AS n0, count(*) FILTER (WHERE c0 > 0) AS t0, sum(c1) AS n1,
    count(*) FILTER (WHERE c1 > 0) AS t1 FROM pairs GROUP BY v),
endings AS (
  SELECT w, count(*) FILTER (WHERE c0 > 0) AS k0, count(*) FILTER (WHERE c1 > 0) AS k1 FROM pairs GROUP BY w),
upper_totals AS (
  SELECT count(*) FILTER (WHERE c0 = 1) / (count(*) FILTER (WHERE c0 = 1) + 2.0 * count(*) FILTER (WHERE c0 = 2)) AS d0,
    count(*) FILTER (WHERE c1 = 1) / (count(*) FILTER (WHERE c1 = 1) + 2.0 * count(*) FILTER (WHERE c1 = 2)) AS d1
  FROM pairs),
lower_totals AS (
  SELECT CAST(count(*) + 1 AS DOUBLE) AS words,
    count(*) FILTER (WHERE k0 = 1) / (count(*) FILTER (WHERE k0 = 1) + 2.0 * count(*) FILTER (WHERE k0 = 2)) AS e0,
    count(*) FILTER (WHERE k1 = 1) / (count(*) FILTER (WHERE k1 = 1) + 2.0 * count(*) FILTER (WHERE k1 = 2)) AS e1,
    CAST(sum(k0) AS DOUBLE) AS s0, CAST(sum(k1) AS DOUBLE) AS s1,
    CAST(count(*) FILTER (WHERE k0 > 0) AS DOUBLE) AS u0, CAST(count(*) FILTER (WHERE k1 > 0) AS DOUBLE) AS u1
  FROM endings)"""


def chance(c: int) -> str:
    """Probability of a word after another in class ``c``."""
    lower = f"(greatest(coalesce(k{c}, 0) - e{c}, 0) / s{c} + e{c} * u{c} / s{c} / words)"
    upper = f"(greatest(coalesce(c{c}, 0) - d{c}, 0) + d{c} * t{c} * {lower}) / n{c}"
    return f"CASE WHEN coalesce(n{c}, 0) > 0 THEN {upper} ELSE {lower} END"


SCORED_PAIRS = f"""{PAIRS}, scored AS (
  SELECT doc_id, split, label, count(*) AS n_pairs, sum(ln({chance(1)}) - ln({chance(0)})) AS llr
  FROM tokens LEFT JOIN pairs USING (v, w) LEFT JOIN contexts USING (v) LEFT JOIN endings USING (w),
    upper_totals, lower_totals
  GROUP BY doc_id, split, label)"""


def sequences(spark, sf_dir):
    rows = classifiers.sequence_input(split_labelled(spark, sf_dir)).drop("text")
    rows = materialise(rows, "sequences")
    return rows, sequence.fit_pair_model(rows.where("split = 'train'"))


def scored_sequences(spark, sf_dir):
    rows, model = sequences(spark, sf_dir)
    return sequence.score_pairs(rows, model, ["split", "label"])


@query("pair_discounts", f"""WITH {PAIRS} SELECT round(d0, 9) AS d0, round(d1, 9) AS d1, round(e0, 9) AS e0,
  round(e1, 9) AS e1, s0, s1, u0, u1, words FROM upper_totals, lower_totals""")
def pair_discounts(spark, sf_dir):
    """Discounts and totals of the two language models."""
    totals = sequences(spark, sf_dir)[1].totals
    return totals.withColumns({n: F.round(n, 9) for n in ("d0", "d1", "e0", "e1")})


@query("pair_contexts", f"WITH {PAIRS} SELECT v, CAST(n0 AS BIGINT) AS n0, t0, CAST(n1 AS BIGINT) AS n1, t1 FROM contexts")
def pair_contexts(spark, sf_dir):
    """How often, and by how many words, each word is followed in either class."""
    return sequences(spark, sf_dir)[1].contexts


@query(
    "sequence_scores",
    f"""WITH {SCORED_PAIRS} SELECT doc_id, split, label, n_pairs, round(llr, 4) AS llr,
  CAST(llr > 0 AS INTEGER) AS prediction FROM scored""",
)
def sequence_scores(spark, sf_dir):
    """Log likelihood ratio of every labelled document between the two classes' language models."""
    return scored_sequences(spark, sf_dir).withColumn("llr", F.round("llr", 4)).drop("prob")


@query(
    "sequence_quality",
    f"""WITH {SCORED_PAIRS}, means AS (SELECT split, label, 1 / (1 + exp(-llr / n_pairs)) AS prob FROM scored),
counts AS (SELECT split, prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM means GROUP BY split, prob),
below AS (SELECT split, pos, neg, sum(neg) OVER (PARTITION BY split ORDER BY prob) - neg / 2.0 AS lower FROM counts)
SELECT split, round(sum(pos * lower) / (sum(pos) * sum(neg)), 6) AS auc FROM below GROUP BY split""",
)
def sequence_quality(spark, sf_dir):
    """Area under the curve of the order-aware classifier on each split."""
    scores = materialise(scored_sequences(spark, sf_dir), "scores")
    found = curves.ranking_quality(curves.score_totals(scores, ["split"]), ["split"])
    return found.select("split", F.round("auc", 6).alias("auc"))


@query("sequence_evaluation")
def sequence_evaluation(spark, sf_dir):
    """Threshold chosen on validation scores, measured on the test split."""
    scores = materialise(scored_sequences(spark, sf_dir), "scores")
    return evaluation.final_test(scores.where("split = 'val'"), scores.where("split = 'test'"))
