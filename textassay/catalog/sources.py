"""Scans and sinks, over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textassay.catalog.base import (
    HEDGES_SQL,
    LABELLED,
    MAXLEN,
    labelled,
    query,
    sql_text,
    table,
    words_sql,
)
from textassay.catalog.evaluation import ERRORS, scored
from textassay.catalog.features import TFIDF, tfidf_features
from textassay.catalog.text import TRAIN_WORDS, damaged
from textassay.functions import text as tx
from textassay.operators import errors, joins, ordered, profiles
from textassay.plans.preprocess import preprocess
from textassay.session import scratch_path
from textassay.sources import claims, features, reports


def claims_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "claims_csv")
    rows = labelled(spark, sf_dir).select(
        F.col("text").alias("claim"), "label", F.lit("tables").alias("source")
    )
    claims.write_claims(rows, path, "csv")
    return path


@query(
    "csv_claims",
    f"WITH {LABELLED} SELECT text AS claim, label FROM labelled",
)
def csv_claims(spark, sf_dir):
    return claims.read_claims(spark, claims_csv(spark, sf_dir))


@query(
    "processed_dataset",
    f"WITH {LABELLED} SELECT text AS claim, label FROM labelled",
)
def processed_dataset(spark, sf_dir):
    path = scratch_path(spark, "claims")
    claims.write_claims(claims.read_claims(spark, claims_csv(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query(
    "enriched_posts",
    f"""SELECT text AS content, lang AS misinformation_type,
  CAST(len(list_filter({words_sql("lower(text)")}, lambda w: list_contains({HEDGES_SQL}, w)))
    AS INTEGER) AS hedge_words_count,
  CAST(len(regexp_extract_all(text, {sql_text(tx.SYMBOL_PATTERN)})) AS INTEGER) AS symbols,
  CAST(len(list_filter({words_sql("text")}, lambda w: regexp_matches(w,
    {sql_text(tx.CAPS_PATTERN)}))) AS INTEGER) AS all_caps FROM documents""",
)
def enriched_posts(spark, sf_dir):
    path = scratch_path(spark, "enriched_csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    styled = profiles.style_counts(docs.withColumn("content", F.col("text")))
    styled.select(
        "content",
        F.col("source").alias("username"),
        F.lit("2024-01-01").alias("upload_date"),
        F.lit("news").alias("category"),
        F.col("lang").alias("misinformation_type"),
        F.lit("tables").alias("datasource"),
        "hedge_words_count",
        "symbols",
        "all_caps",
    ).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return claims.read_enriched_posts(
        spark, path, ["content", "misinformation_type", *claims.COUNT_COLUMNS]
    )


@query("preview_rows", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")
def preview_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return ordered.preview(docs, "doc_id")


def feature_table(spark, sf_dir) -> str:
    path = scratch_path(spark, "features")
    features.write_features(tfidf_features(spark, sf_dir), path)
    return path


FEATURES_SQL = "SELECT doc_id, label, term, round(tfidf, 6) AS tfidf"


@query("features_one_split", f"WITH {TFIDF} {FEATURES_SQL} FROM tfidf WHERE split = 'train'")
def features_one_split(spark, sf_dir):
    rows = features.load_features(spark, feature_table(spark, sf_dir), "train")
    return rows.select("doc_id", "label", "term", F.round("tfidf", 6).alias("tfidf"))


@query(
    "features_three_splits",
    f"WITH {TFIDF} SELECT split, label, count(*) AS n FROM tfidf GROUP BY split, label",
)
def features_three_splits(spark, sf_dir):
    train, val, test = features.load_splits(spark, feature_table(spark, sf_dir))
    rows = train.unionByName(val).unionByName(test)
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "features_unsplit",
    f"WITH {TFIDF} SELECT doc_id, label, count(*) AS n_terms FROM tfidf GROUP BY doc_id, label",
)
def features_unsplit(spark, sf_dir):
    rows = features.load_features(spark, feature_table(spark, sf_dir))
    return rows.groupBy("doc_id", "label").agg(F.count("*").alias("n_terms"))


@query(
    "misclassified_csv",
    f"""WITH {ERRORS} SELECT text AS claim, label AS true_label, prediction AS pred_label,
  prob AS pred_prob FROM errors""",
)
def misclassified_csv(spark, sf_dir):
    path = scratch_path(spark, "misclassified_csv")
    wrong = errors.misclassified(scored(spark, sf_dir))
    reports.write_misclassified(
        joins.attach_text(wrong, table(spark, sf_dir, "documents")), path
    )
    schema = "claim string, true_label int, pred_label int, pred_prob double"
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').csv(path)


REPORT_SQL = f"""WITH {TRAIN_WORDS.replace("WHERE d.text IS NOT NULL AND l.quality IS NOT NULL", "")}
SELECT {MAXLEN} AS maxlen, (SELECT count(*) + 2 FROM vocabulary) AS vocab_size,
  (SELECT count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id) AS rows_total,
  count(*) AS rows_used,
  (SELECT count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id) - count(*)
    AS rows_dropped,
  count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test,
  count(*) FILTER (WHERE split = 'train' AND label = 1) AS train_1,
  count(*) FILTER (WHERE split = 'test' AND label = 0) AS test_0
FROM split"""


@query("run_report", REPORT_SQL)
def run_report(spark, sf_dir):
    """The preprocessing report, written as JSON and read back."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stored_report(spark, preprocess(report_rows(rows), MAXLEN, repair=False).report)


@query("repaired_report", REPORT_SQL)
def repaired_report(spark, sf_dir):
    """The same of broken texts, which are repaired before they are cleaned."""
    rows = damaged(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id")
    return stored_report(spark, preprocess(report_rows(rows), MAXLEN).report)


def report_rows(rows):
    return rows.select("doc_id", "text", F.col("quality").alias("label"))


def stored_report(spark, report):
    path = scratch_path(spark, "report")
    reports.write_report(report, path)
    splits = F.col("splits")
    return spark.read.schema(report.schema).json(path).select(
        "maxlen",
        "vocab_size",
        "rows_total",
        "rows_used",
        "rows_dropped",
        splits["train"]["n"].alias("n_train"),
        splits["val"]["n"].alias("n_val"),
        splits["test"]["n"].alias("n_test"),
        splits["train"]["classes"]["1"].alias("train_1"),
        splits["test"]["classes"]["0"].alias("test_0"),
    )
