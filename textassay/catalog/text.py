"""Scalar text functions, labels, vocabularies and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.catalog.base import (
    CLEANING_SQL,
    HEDGES_SQL,
    LABELLED,
    MAXLEN,
    SPLIT,
    clean_words_sql,
    cleaned_sequence_sql,
    labelled,
    ngrams_sql,
    query,
    sequence_words_sql,
    split_labelled,
    sql_text,
    strip_punctuation_sql,
    strip_tags_sql,
    table,
    terms_sql,
    texts,
    words_sql,
)
from textassay.functions import labels as lab
from textassay.functions import text as tx
from textassay.operators import metrics, profiles, vocab
from textassay.operators.joins import attach_labels, attach_measure
from textassay.session import materialise


def cleaned_sequences(df: DataFrame) -> DataFrame:
    """``text`` replaced by the sequence words of the cleaned text."""
    return df.withColumn("words", tx.sequence_words(tx.clean_text(F.col("text")))).drop("text")


def sequence_lengths(spark, sf_dir) -> DataFrame:
    """Words of each labelled text after cleaning."""
    length = F.size(tx.sequence_words(tx.clean_text(F.col("text"))))
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return attach_measure(docs, table(spark, sf_dir, "labels"), length).select(F.col("measure").alias("length"))


@query(
    "recommended_length",
    f"""WITH {LABELLED}, lengths AS (
  SELECT CAST(len({cleaned_sequence_sql("text")}) AS INTEGER) AS length FROM labelled),
raw AS (SELECT CAST(floor(quantile_cont(length, 0.95)) AS INTEGER) AS v FROM lengths)
SELECT least(greatest(v, 32), 512) AS recommended_maxlen, CAST(95 AS DOUBLE) AS percentile_used,
  v AS raw_percentile_value FROM raw""",
)
def recommended_length(spark, sf_dir):
    return profiles.recommended_length(sequence_lengths(spark, sf_dir))


LENGTHS_SQL = f"""WITH {LABELLED}, lengths AS (
  SELECT CAST(len({cleaned_sequence_sql("text")}) AS INTEGER) AS length FROM labelled)
SELECT count(*) AS count, min(length) AS min, round(avg(length), 6) AS mean,
  CAST(median(length) AS DOUBLE) AS median,
  CAST(floor(quantile_cont(length, 0.9)) AS INTEGER) AS p90,
  CAST(floor(quantile_cont(length, 0.95)) AS INTEGER) AS p95,
  CAST(floor(quantile_cont(length, 0.99)) AS INTEGER) AS p99, max(length) AS max
FROM lengths"""


@query("length_stats", LENGTHS_SQL)
def length_stats(spark, sf_dir):
    return profiles.length_stats(sequence_lengths(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(
    "labelled_text",
    "SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l "
    "ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL",
)
def labelled_text(spark, sf_dir):
    return attach_labels(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic"
    )


@query(
    "drop_missing",
    """SELECT d.doc_id, d.n_chars, l.quality AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""",
)
def drop_missing(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    kept = joined.withColumnRenamed("quality", "label").dropna(subset=["text", "label"])
    return kept.select("doc_id", "n_chars", "label")


@query(
    "emptied_by_cleaning",
    f"""WITH cleaned AS (
  SELECT lang, array_to_string({clean_words_sql("text")}, ' ') AS cleaned FROM documents)
SELECT lang, count(*) AS rows_read, count(*) FILTER (WHERE cleaned <> '') AS rows_kept,
  count(*) FILTER (WHERE cleaned = '') AS rows_emptied FROM cleaned GROUP BY lang""",
)
def emptied_by_cleaning(spark, sf_dir):
    docs = texts(spark, sf_dir)
    cleaned = docs.select("lang", tx.clean_text(F.col("text")).alias("cleaned"))
    empty = F.trim("cleaned") == ""
    return cleaned.groupBy("lang").agg(
        F.count("*").alias("rows_read"),
        F.count_if(~empty).alias("rows_kept"),
        F.count_if(empty).alias("rows_emptied"),
    )


@query("flip_labels", "SELECT doc_id, 1 - quality AS label FROM labels")
def flip_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", lab.positive_is_one(F.col("quality"), 0).alias("label"))


@query(
    "strict_labels",
    "SELECT doc_id, CAST(CAST(quality AS VARCHAR) AS INTEGER) AS label FROM labels",
)
def strict_labels(spark, sf_dir):
    text_labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("label")
    )
    return text_labels.select("doc_id", lab.strict_label(F.col("label")).alias("label"))


@query(
    "claims_as_text",
    """SELECT doc_id, CAST(text AS VARCHAR) AS claim, CAST(n_chars AS VARCHAR) AS length
FROM documents WHERE text IS NOT NULL""",
)
def claims_as_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").dropna(subset=["text"])
    return docs.select(
        "doc_id",
        F.col("text").cast("string").alias("claim"),
        F.col("n_chars").cast("string").alias("length"),
    )


@query(
    "label_names",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'Misinformation' ELSE 'True' END AS label_name,
  CASE WHEN quality = 1 THEN 0 ELSE 1 END AS display_order FROM labels""",
)
def label_names(spark, sf_dir):
    y = F.col("quality")
    return table(spark, sf_dir, "labels").select(
        "doc_id", lab.label_name(y).alias("label_name"), lab.label_order(y).alias("display_order")
    )


@query("strip_tags", f"SELECT page_id, {strip_tags_sql('html')} AS bare FROM pages")
def strip_tags(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("bare"))


@query(
    "strip_punctuation", f"SELECT doc_id, {strip_punctuation_sql('text')} AS bare FROM documents"
)
def strip_punctuation(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", tx.strip_punctuation(F.col("text")).alias("bare")
    )


@query(
    "lower_strip",
    "SELECT doc_id, regexp_replace(lower(text), "
    + sql_text(rf"^[{tx.SPACE}]+|[{tx.SPACE}]+$")
    + ", '', 'g') AS bare FROM documents",
)
def lower_strip(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", tx.lower_strip(F.col("text")).alias("bare")
    )


@query(
    "squeeze_spaces",
    f"SELECT doc_id, array_to_string({words_sql('text')}, ' ') AS squeezed FROM documents",
)
def squeeze_spaces(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", tx.squeeze_spaces(F.col("text")).alias("squeezed")
    )


@query(
    "drop_stop_words",
    f"""SELECT doc_id, array_to_string(list_filter({words_sql("lower(text)")},
  lambda w: NOT list_contains({CLEANING_SQL}, w)), ' ') AS kept
FROM documents""",
)
def drop_stop_words(spark, sf_dir):
    kept = tx.drop_words(tx.words(F.lower("text")))
    return texts(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(
    "clean_text",
    f"SELECT doc_id, array_to_string({clean_words_sql('text')}, ' ') AS cleaned FROM documents",
)
def clean_text(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", tx.clean_text(F.col("text")).alias("cleaned")
    )


@query(
    "clean_pages",
    f"SELECT page_id, array_to_string({clean_words_sql('html')}, ' ') AS cleaned FROM pages",
)
def clean_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select(
        "page_id", tx.clean_text(F.col("html")).alias("cleaned")
    )


def damaged(docs: DataFrame) -> DataFrame:
    """Texts read with the wrong table, every other one twice."""
    misread = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    once = misread(F.col("text"))
    return docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, misread(once)).otherwise(once))


@query(
    "repair_text",
    "SELECT doc_id, nfc_normalize(text) AS repaired FROM documents",
)
def repair_text(spark, sf_dir):
    """Break every text (UTF-8 read as Latin-1), then repair it."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = texts(spark, sf_dir).select("doc_id", broken.alias("broken"))
    return docs.select("doc_id", tx.repair_text(F.col("broken")).alias("repaired"))


@query("repaired_lengths", LENGTHS_SQL)
def repaired_lengths(spark, sf_dir):
    """The length figures of broken texts (UTF-8 read as cp1252 or Latin-1, twice for some) after repair and cleaning."""
    length = F.size(tx.sequence_words(tx.clean_text(tx.repair_text(F.col("text")))))
    docs = damaged(texts(spark, sf_dir, "documents", "doc_id", "text"))
    lengths = attach_measure(docs, table(spark, sf_dir, "labels"), length).select(F.col("measure").alias("length"))
    return profiles.length_stats(lengths).withColumn("mean", F.round("mean", 6))


@query(
    "term_ngrams",
    f"""WITH t AS (SELECT doc_id, {terms_sql("text")} AS w FROM documents),
g AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS n_terms, {ngrams_sql("w")} AS g FROM t)
SELECT doc_id, n_terms, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM g""",
)
def term_ngrams(spark, sf_dir):
    docs = texts(spark, sf_dir).withColumn("w", tx.terms(F.col("text")))
    docs = docs.select("doc_id", F.size("w").alias("n_terms"), tx.ngrams(F.col("w")).alias("g"))
    return docs.select(
        "doc_id",
        "n_terms",
        F.size("g").alias("n_grams"),
        F.md5(F.array_join("g", "|")).alias("digest"),
    )


@query(
    "sequence_words",
    f"""SELECT doc_id, array_to_string({sequence_words_sql("text")}, ' ') AS words,
  CAST(len({sequence_words_sql("text")}) AS INTEGER) AS length FROM documents""",
)
def sequence_words(spark, sf_dir):
    docs = texts(spark, sf_dir).select(
        "doc_id", tx.sequence_words(F.col("text")).alias("w")
    )
    return docs.select("doc_id", F.array_join("w", " ").alias("words"), F.size("w").alias("length"))


@query(
    "style_counts",
    f"""SELECT doc_id,
  CAST(len(list_filter({words_sql("lower(text)")}, lambda w: list_contains({HEDGES_SQL}, w)))
    AS INTEGER) AS hedge_words_count,
  CAST(len(regexp_extract_all(text, {sql_text(tx.SYMBOL_PATTERN)})) AS INTEGER) AS symbols,
  CAST(len(list_filter({words_sql("text")}, lambda w: regexp_matches(w,
    {sql_text(tx.CAPS_PATTERN)}))) AS INTEGER) AS all_caps
FROM documents""",
)
def style_counts(spark, sf_dir):
    return profiles.style_counts(texts(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "class_counts",
    f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY split, label",
)
def class_counts(spark, sf_dir):
    return metrics.class_counts(split_labelled(spark, sf_dir), ["split", "label"])


TRAIN_WORDS = f"""{SPLIT}, words AS (
  SELECT doc_id, split, {cleaned_sequence_sql("text")} AS w FROM split),
counted AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM words WHERE split = 'train')
  GROUP BY word),
vocabulary AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 1 AS idx FROM counted)"""


def _train_vocabulary(spark, sf_dir):
    rows = materialise(cleaned_sequences(split_labelled(spark, sf_dir)), "split_words")
    vocabulary = vocab.build_vocabulary(rows.where("split = 'train'"))
    return rows, vocab.store_vocabulary(vocabulary)


@query("word_counts", f"WITH {TRAIN_WORDS} SELECT word, n FROM counted")
def word_counts(spark, sf_dir):
    rows = cleaned_sequences(split_labelled(spark, sf_dir))
    return vocab.word_counts(rows.where("split = 'train'"))


@query("vocabulary", f"WITH {TRAIN_WORDS} SELECT word, n, idx FROM vocabulary")
def vocabulary(spark, sf_dir):
    rows = cleaned_sequences(split_labelled(spark, sf_dir))
    return vocab.build_vocabulary(rows.where("split = 'train'"))


INDEXED = f"""{TRAIN_WORDS}, exploded AS (
  SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
  FROM words),
indexed AS (
  SELECT e.doc_id, e.pos, e.word, CAST(coalesce(v.idx, 1) AS INTEGER) AS idx
  FROM exploded e LEFT JOIN vocabulary v ON e.word = v.word)"""


@query("word_indices", f"WITH {INDEXED} SELECT doc_id, pos, word, idx FROM indexed")
def word_indices(spark, sf_dir):
    rows, vocabulary = _train_vocabulary(spark, sf_dir)
    return vocab.word_indices(rows, vocabulary)


@query(
    "encoded_sequences",
    f"""WITH {INDEXED}, seqs AS (
  SELECT doc_id, string_agg(idx, ',' ORDER BY pos) AS seq, count(*) AS length
  FROM indexed GROUP BY doc_id)
SELECT s.doc_id, coalesce(q.seq, '') AS seq, coalesce(q.length, 0) AS length
FROM split s LEFT JOIN seqs q ON s.doc_id = q.doc_id""",
)
def encoded_sequences(spark, sf_dir):
    rows, vocabulary = _train_vocabulary(spark, sf_dir)
    seqs = vocab.encode(rows, vocabulary)
    return seqs.select(
        "doc_id", F.array_join("seq", ",").alias("seq"), F.size("seq").cast("long").alias("length")
    )


@query(
    "padded_sequences",
    f"""WITH {INDEXED}, seqs AS (
  SELECT doc_id, list(idx ORDER BY pos) AS seq FROM indexed GROUP BY doc_id)
SELECT s.doc_id, s.split, s.label, array_to_string(list_concat(coalesce(q.seq, []),
  list_transform(range({MAXLEN}), lambda i: 0))[1:{MAXLEN}], ',') AS seq
FROM split s LEFT JOIN seqs q ON s.doc_id = q.doc_id""",
)
def padded_sequences(spark, sf_dir):
    rows, vocabulary = _train_vocabulary(spark, sf_dir)
    keep = ("split", "label")
    seqs = vocab.encode_padded(rows, vocabulary, MAXLEN, keep=keep)
    return seqs.select("doc_id", *keep, F.array_join("seq", ",").alias("seq"))
