"""Quality of given scores, error analysis, clusters, box plots."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textassay.catalog.base import (
    HEDGES_SQL,
    SCORED,
    SPLIT,
    query,
    scored,
    split_labelled,
    sql_text,
    table,
    texts,
    words_sql,
)
from textassay.catalog.splits import FOLDS
from textassay.functions import labels as lab
from textassay.functions import text as tx
from textassay.operators import clusters, curves, errors, joins, metrics, profiles, splits


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def scored_text(spark, sf_dir):
    return joins.attach_text(scored(spark, sf_dir), table(spark, sf_dir, "documents"))


def scored_split(spark, sf_dir):
    return splits.stratified_split(scored(spark, sf_dir))


SCORED_SPLIT = f"""{SPLIT}, scored AS (
  SELECT s.doc_id, s.label, s.split, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS prob,
    CASE WHEN CAST(d.n_chars % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM split s JOIN documents d ON s.doc_id = d.doc_id)"""

ERRORS = f"""{SCORED}, errors AS (
  SELECT s.*, d.text, CASE WHEN s.prediction = 1 THEN 'FP' ELSE 'FN' END AS error_type
  FROM scored s JOIN documents d ON s.doc_id = d.doc_id WHERE s.label <> s.prediction)"""


@query(
    "thresholded",
    f"WITH {SCORED} SELECT doc_id, CASE WHEN prob >= 0.33 THEN 1 ELSE 0 END AS prediction FROM scored",
)
def thresholded(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", lab.decide(F.col("prob"), 0.33).alias("prediction"))


@query(
    "misclassified",
    f"WITH {ERRORS} SELECT doc_id, error_type, label, prediction, prob, text FROM errors",
)
def misclassified(spark, sf_dir):
    wrong = errors.misclassified(scored(spark, sf_dir))
    with_text = joins.attach_text(wrong, table(spark, sf_dir, "documents"))
    return with_text.select("doc_id", "error_type", "label", "prediction", "prob", "text")


@query(
    "error_union",
    f"WITH {ERRORS} SELECT doc_id, error_type FROM errors",
)
def error_union(spark, sf_dir):
    rows = scored(spark, sf_dir)
    both = errors.false_positives(rows).unionByName(errors.false_negatives(rows))
    return both.select("doc_id", "error_type")


@query(
    "text_excerpts",
    "SELECT doc_id, substr(text, 1, 200) AS excerpt FROM documents",
)
def text_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", lab.excerpt(F.col("text")).alias("excerpt")
    )


@query(
    "predictions_with_text",
    f"WITH {SCORED} SELECT s.doc_id, s.label, s.prediction, s.prob, d.text FROM scored s "
    "JOIN documents d ON s.doc_id = d.doc_id",
)
def predictions_with_text(spark, sf_dir):
    return scored_text(spark, sf_dir).select("doc_id", "label", "prediction", "prob", "text")


@query(
    "error_words",
    f"""WITH {ERRORS}, counted AS (
  SELECT error_type, word, count(*) AS n
  FROM (SELECT error_type, unnest({words_sql("lower(text)")}) AS word FROM errors)
  GROUP BY error_type, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY n DESC, word) AS rank
  FROM counted)
SELECT error_type, CAST(rank AS INTEGER) AS rank, word, n FROM ranked WHERE rank <= 15""",
)
def error_words(spark, sf_dir):
    wrong = errors.misclassified(scored(spark, sf_dir))
    return errors.error_words(joins.attach_text(wrong, table(spark, sf_dir, "documents")))


@query(
    "error_examples",
    f"""WITH {ERRORS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY doc_id) AS rank FROM errors)
SELECT error_type, CAST(rank AS INTEGER) AS rank, doc_id, prob, substr(text, 1, 200) AS excerpt
FROM ranked WHERE rank <= 10""",
)
def error_examples(spark, sf_dir):
    wrong = errors.misclassified(scored(spark, sf_dir))
    return errors.error_examples(wrong, table(spark, sf_dir, "documents"))


@query(
    "error_summary",
    f"""WITH {SCORED}, c AS (SELECT count(*) AS total,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = prediction) AS correct FROM scored)
SELECT total, fp, fn, round(fp / total, 6) AS fp_share, round(fn / total, 6) AS fn_share,
  round(correct / total, 6) AS accuracy FROM c""",
)
def error_summary(spark, sf_dir):
    return rounded(errors.error_summary(scored(spark, sf_dir)), "fp_share", "fn_share", "accuracy")


MATRIX = f"""{SCORED}, classes AS (SELECT unnest([0, 1]) AS c),
matrix AS (
  SELECT a.c AS label, p.c AS prediction, count(s.doc_id) AS n
  FROM classes a CROSS JOIN classes p
  LEFT JOIN scored s ON s.label = a.c AND s.prediction = p.c GROUP BY a.c, p.c)"""


@query("confusion_matrix", f"WITH {MATRIX} SELECT label, prediction, n FROM matrix")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored(spark, sf_dir))


@query(
    "normalised_confusion",
    f"WITH {MATRIX} SELECT label, prediction, "
    "round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM matrix",
)
def normalised_confusion(spark, sf_dir):
    matrix = metrics.confusion_matrix(scored(spark, sf_dir))
    return rounded(metrics.normalised_confusion(matrix), "share")


def _summary_sql(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""c AS (SELECT {head}count(*) AS total,
    count(*) FILTER (WHERE label = prediction) AS correct,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM {source}{tail}),
summary AS (SELECT {head}total, correct, correct / total AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


@query(
    "binary_metrics",
    f"""WITH {SCORED}, {_summary_sql("scored")}
SELECT total, correct, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM summary""",
)
def binary_metrics(spark, sf_dir):
    summary = metrics.binary_summary(scored(spark, sf_dir))
    return rounded(summary, "accuracy", "precision", "recall", "f1")


@query(
    "model_score",
    f"""WITH {SCORED} SELECT count(*) FILTER (WHERE label = prediction) AS correct,
  count(*) AS total FROM scored""",
)
def model_score(spark, sf_dir):
    return metrics.binary_summary(scored(spark, sf_dir)).select("correct", "total")


@query(
    "metrics_by_split",
    f"""WITH {SCORED_SPLIT}, held_out AS (SELECT * FROM scored WHERE split <> 'train'),
{_summary_sql("held_out", "split")}
SELECT split, total, correct, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM summary""",
)
def metrics_by_split(spark, sf_dir):
    held_out = scored_split(spark, sf_dir).where("split <> 'train'")
    summary = metrics.binary_summary(held_out, ["split"])
    return rounded(summary, "accuracy", "precision", "recall", "f1")


@query(
    "classification_report",
    f"""WITH {MATRIX}, per_class AS (
  SELECT c.c AS class,
    (SELECT CAST(sum(n) AS BIGINT) FROM matrix WHERE label = c.c) AS support,
    (SELECT CAST(sum(n) AS BIGINT) FROM matrix WHERE prediction = c.c) AS predicted,
    (SELECT n FROM matrix WHERE label = c.c AND prediction = c.c) AS hit FROM classes c),
measured AS (
  SELECT CAST(class AS VARCHAR) AS class, coalesce(hit / nullif(predicted, 0), 0) AS precision,
    coalesce(hit / nullif(support, 0), 0) AS recall,
    coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f1, support, hit FROM per_class),
report AS (
  SELECT class, precision, recall, f1, support FROM measured
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support),
    sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM measured
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
    CAST(sum(support) AS BIGINT) FROM measured
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
    CAST(sum(support) AS BIGINT) FROM measured)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support FROM report""",
)
def classification_report(spark, sf_dir):
    report = metrics.classification_report(scored(spark, sf_dir))
    return rounded(report, "precision", "recall", "f1")


@query(
    "score_rmse",
    f"WITH {SCORED} SELECT round(sqrt(avg((prob - label) ** 2)), 6) AS rmse FROM scored",
)
def score_rmse(spark, sf_dir):
    return rounded(metrics.rmse(scored(spark, sf_dir)), "rmse")


@query(
    "class_weights",
    f"""WITH {SPLIT}, c AS (
  SELECT label, count(*) AS n FROM split WHERE split = 'train' GROUP BY label)
SELECT label, round(CASE WHEN count(*) OVER () > 1
  THEN sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE) ELSE 1 END, 6) AS weight FROM c""",
)
def class_weights(spark, sf_dir):
    train = split_labelled(spark, sf_dir).where("split = 'train'")
    return rounded(metrics.class_weights(train), "weight")


@query(
    "fold_summary",
    f"""WITH {FOLDS}, sizes AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS size),
runs AS (
  SELECT z.size, f.fold, f.label,
    CASE WHEN CAST(d.n_chars % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM folds f JOIN documents d ON f.doc_id = d.doc_id JOIN sizes z ON f.step <= z.size),
scores AS (
  SELECT size, fold, coalesce(2 * count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(
    2 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
    + count(*) FILTER (WHERE label <> prediction), 0), 0) AS f1
  FROM runs GROUP BY size, fold)
SELECT size, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std
FROM scores GROUP BY size""",
)
def fold_summary(spark, sf_dir):
    """F1 of the fixed score on the nested samples of every fold, then its spread."""
    rows = splits.folds(scored(spark, sf_dir))
    sized = rows.withColumn("size", F.explode(F.sequence(F.col("step"), F.lit(10))))
    scores = metrics.binary_summary(sized, ["size", "fold"])
    return rounded(metrics.fold_summary(scores, "size"), "mean", "std")


@query(
    "score_histogram",
    f"""WITH {SCORED}, r AS (SELECT label, min(prob) AS lo, max(prob) AS hi FROM scored GROUP BY label)
SELECT s.label, CAST(CASE WHEN hi > lo THEN least(floor((prob - lo) / ((hi - lo) / 30)), 29)
  ELSE 15 END AS INTEGER) AS bin, count(*) AS n
FROM scored s JOIN r ON s.label = r.label GROUP BY ALL""",
)
def score_histogram(spark, sf_dir):
    return profiles.score_histogram(scored(spark, sf_dir))


def _totals_sql(by: str = "") -> str:
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""counted AS (
  SELECT {head}prob AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
    count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY {head}prob),
totals AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY threshold DESC) AS tp,
    sum(neg) OVER ({part}ORDER BY threshold DESC) AS fp,
    sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS q FROM counted)"""


TOTALS = f"{SCORED}, {_totals_sql()}"
QUALITY = """sum(neg * (tp - pos / 2)) / (max(p) * max(q)) AS auc,
  sum(pos * tp / (tp + fp)) / max(p) AS average_precision"""


@query(
    "roc_points",
    f"WITH {TOTALS} SELECT threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM totals",
)
def roc_points(spark, sf_dir):
    return rounded(curves.roc_points(curves.score_totals(scored(spark, sf_dir))), "fpr", "tpr")


@query(
    "precision_recall_points",
    f"""WITH {TOTALS} SELECT threshold, round(tp / (tp + fp), 6) AS precision,
  round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1 FROM totals""",
)
def precision_recall_points(spark, sf_dir):
    points = curves.pr_points(curves.score_totals(scored(spark, sf_dir)))
    return rounded(points, "precision", "recall", "f1")


@query(
    "ranking_quality",
    f"""WITH {TOTALS}, m AS (SELECT {QUALITY} FROM totals)
SELECT round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM m""",
)
def ranking_quality(spark, sf_dir):
    totals = curves.score_totals(scored(spark, sf_dir))
    return rounded(curves.ranking_quality(totals), "auc", "average_precision")


@query(
    "ranking_quality_by_split",
    f"""WITH {SCORED_SPLIT}, {_totals_sql("split")},
m AS (SELECT split, {QUALITY} FROM totals GROUP BY split)
SELECT split, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM m""",
)
def ranking_quality_by_split(spark, sf_dir):
    totals = curves.score_totals(scored_split(spark, sf_dir), by=["split"])
    return rounded(curves.ranking_quality(totals, ["split"]), "auc", "average_precision")


@query(
    "best_threshold",
    f"""WITH {TOTALS}, f AS (SELECT threshold, tp / (tp + fp) AS precision, tp / p AS recall,
  2 * tp / (tp + fp + p) AS f1 FROM totals)
SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision,
  round(recall, 6) AS recall FROM f ORDER BY f.f1 DESC, threshold LIMIT 1""",
)
def best_threshold(spark, sf_dir):
    points = curves.pr_points(curves.score_totals(scored(spark, sf_dir)))
    return rounded(curves.best_threshold(points), "f1", "precision", "recall")


@query(
    "model_evaluation",
    f"""WITH {TOTALS}, m AS (SELECT {QUALITY} FROM totals),
a AS (SELECT count(*) FILTER (WHERE label = prediction) / count(*) AS accuracy FROM scored)
SELECT round(accuracy, 6) AS accuracy, round(auc, 6) AS auc,
  round(average_precision, 6) AS average_precision FROM a, m""",
)
def model_evaluation(spark, sf_dir):
    from textassay.plans.evaluation import evaluate_scores

    return rounded(evaluate_scores(scored(spark, sf_dir)), "accuracy", "auc", "average_precision")


@query(
    "adjusted_rand",
    """WITH c AS (SELECT label, CAST(vec_id % 7 AS INTEGER) AS cluster FROM embeddings),
n AS (SELECT label, cluster, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT label, sum(n) AS n FROM n GROUP BY label),
b AS (SELECT cluster, sum(n) AS n FROM n GROUP BY cluster),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS cells,
  (SELECT sum(n * (n - 1) / 2) FROM a) AS rows_, (SELECT sum(n * (n - 1) / 2) FROM b) AS cols,
  (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS whole)
SELECT round((cells - rows_ * cols / whole) / ((rows_ + cols) / 2 - rows_ * cols / whole), 6)
  AS ari FROM s""",
)
def adjusted_rand(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "label", (F.col("vec_id") % 7).cast("int").alias("cluster")
    )
    return rounded(clusters.adjusted_rand(rows), "ari")


@query(
    "silhouette",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other,
    sum(list_distance(a.v, b.v) ** 2) AS total, count(*) AS n
  FROM e a CROSS JOIN e b GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id,
    max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
    min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM ab""",
)
def silhouette(spark, sf_dir):
    """Mean silhouette (squared Euclidean) of the labels taken as clusters.

    Linear in the rows: each row is compared with one summary per cluster.
    """
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("prediction"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    value = ClusteringEvaluator(metricName="silhouette").evaluate(rows)
    return spark.range(1).select(F.round(F.lit(float(value)), 6).alias("silhouette"))


EUCLIDEAN = """WITH e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(concat(vec_id, ':42')), vec_id LIMIT %s),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
  FROM e a CROSS JOIN e b GROUP BY a.vec_id, a.label, b.label),
ab AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
    min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY vec_id)
SELECT count(*) AS n,
  round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""


@query("euclidean_silhouette", EUCLIDEAN.replace(" LIMIT %s", ""))
def euclidean_silhouette(spark, sf_dir):
    """Mean silhouette by plain distance of the labels taken as clusters, over all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(clusters.euclidean_silhouette(rows, "vec_id", "label", "embedding", rows=None), "silhouette")


@query("sampled_silhouette", EUCLIDEAN % "400")
def sampled_silhouette(spark, sf_dir):
    """The same on a seeded sample, the operator's bounded mode."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(clusters.euclidean_silhouette(rows, "vec_id", "label", "embedding", rows=400), "silhouette")


@query(
    "box_stats",
    f"""WITH counts AS (
  SELECT lang, len(list_filter({words_sql("lower(text)")}, lambda w: list_contains({HEDGES_SQL}, w)))
      AS hedge_words_count,
    len(regexp_extract_all(text, {sql_text(tx.SYMBOL_PATTERN)})) AS symbols,
    len(list_filter({words_sql("text")}, lambda w: regexp_matches(w, {sql_text(tx.CAPS_PATTERN)})))
      AS all_caps FROM documents),
long AS (SELECT lang, 'hedge_words_count' AS measure, hedge_words_count AS v FROM counts
  UNION ALL SELECT lang, 'symbols', symbols FROM counts
  UNION ALL SELECT lang, 'all_caps', all_caps FROM counts),
q AS (SELECT lang, measure, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM long GROUP BY lang, measure)
SELECT l.lang, l.measure, q1, median, q3,
  CAST(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS INTEGER)
    AS whisker_low,
  CAST(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS INTEGER)
    AS whisker_high,
  count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM long l JOIN q ON l.lang = q.lang AND l.measure = q.measure
GROUP BY l.lang, l.measure, q1, median, q3""",
)
def box_stats(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return profiles.box_stats(profiles.style_counts(docs), "lang")
