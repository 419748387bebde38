"""Registry, table access, and the SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions import stopwords
from textassay.functions.labels import decide
from textassay.functions.text import (
    PUNCT_PATTERN,
    SEQUENCE_FILTERS,
    SPLIT_PATTERN,
    TAG_PATTERN,
    TERM_PATTERN,
)
from textassay.operators.joins import attach_labels
from textassay.operators.splits import stratified_split
from textassay.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAXLEN = 273  # default length of a padded sequence


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", *columns: str) -> DataFrame:
    """A table of texts about to be worked on row by row."""
    key = {"documents": "doc_id", "pages": "page_id"}[name]
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df, key)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, label)``: documents with their quality label."""
    documents = texts(spark, sf_dir, "documents", "doc_id", "text")
    return attach_labels(documents, table(spark, sf_dir, "labels"))


def split_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(labelled(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, prob, prediction)`` with a fixed score full of ties."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("prob")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return (
        docs.join(labels, "doc_id")
        .select("doc_id", "label", "prob")
        .withColumn("prediction", decide(F.col("prob")))
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, x, y)``: two coordinates of each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


# --- SQL fragments ------------------------------------------------------------


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_text(w) for w in items) + "]"


CLEANING_SQL = sql_list(stopwords.CLEANING)
ENGLISH_SQL = sql_list(stopwords.ENGLISH)
HEDGES_SQL = sql_list(stopwords.HEDGES)


def strip_tags_sql(c: str) -> str:
    return f"regexp_replace({c}, {sql_text(TAG_PATTERN)}, '', 'g')"


def strip_punctuation_sql(c: str) -> str:
    return f"regexp_replace({c}, {sql_text(PUNCT_PATTERN)}, '', 'g')"


def words_sql(c: str) -> str:
    split = f"string_split_regex({c}, {sql_text(SPLIT_PATTERN)})"
    return f"list_filter({split}, lambda w: w <> '')"


def clean_words_sql(c: str) -> str:
    bare = f"lower({strip_punctuation_sql(strip_tags_sql(c))})"
    return f"list_filter({words_sql(bare)}, lambda w: NOT list_contains({CLEANING_SQL}, w))"


def sequence_words_sql(c: str) -> str:
    visible = "".join(ch for ch in SEQUENCE_FILTERS if ch not in "\t\n")
    n = len(SEQUENCE_FILTERS)
    blanked = f"translate(lower({c}), {sql_text(visible)} || chr(9) || chr(10), repeat(' ', {n}))"
    return f"list_filter(string_split({blanked}, ' '), lambda w: w <> '')"


def cleaned_sequence_sql(c: str) -> str:
    return sequence_words_sql(f"array_to_string({clean_words_sql(c)}, ' ')")


def terms_sql(c: str) -> str:
    found = f"regexp_extract_all(lower({c}), {sql_text(TERM_PATTERN)})"
    return f"list_filter({found}, lambda w: NOT list_contains({ENGLISH_SQL}, w))"


def ngrams_sql(w: str) -> str:
    two = f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    three = (
        f"list_transform(range(1, len({w}) - 1), "
        f"lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])"
    )
    return f"list_concat({w}, list_concat({two}, {three}))"


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, l.quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND l.quality IS NOT NULL)"""

SPLIT = f"""{LABELLED},
ranked AS (
  SELECT doc_id, text, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS rn
  FROM labelled),
split AS (
  SELECT doc_id, text, label,
    CASE WHEN rn <= n * 7 // 10 THEN 'train' WHEN rn <= n * 17 // 20 THEN 'val'
         ELSE 'test' END AS split
  FROM ranked)"""

SCORED = """scored AS (
  SELECT d.doc_id, l.quality AS label, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS prob,
    CASE WHEN CAST(d.n_chars % 1000 AS DOUBLE) / 1000 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

POINTS = """points AS (
  SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings)"""
