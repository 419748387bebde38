"""The named queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.llm import (
    boilerplate, bpe, chat, chunks, fingerprint, language, negatives, packing, pii, simhash,
    spelling, vectors, warc,
)
from textassay.session import materialise, scratch_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, a table of few files spread over the cores."""
    return spread(read(spark, sf_dir, "documents").select(*columns or ["*"]), "doc_id")


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edit_likeness(documents(spark, sf_dir, "doc_id", "text"))
    found = found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return fingerprint.beside_next(materialise(found, "likeness"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    learned = language.sample_languages(docs.where(F.coalesce(~held_out(), F.lit(False))))
    found = language.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


LINES_SQL = """
WITH pages AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, string_split(text, chr(10)) AS lines
  FROM documents),
each AS (
  SELECT doc_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM pages),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
counts AS (
  SELECT host, line, count(DISTINCT doc_id) AS n FROM each WHERE trim(line) <> '' GROUP BY host, line),
frequent AS (
  SELECT host, line, true AS hit FROM counts JOIN totals USING (host)
  WHERE n >= 2 AND n > CAST(0.05 AS DOUBLE) * pages)
SELECT doc_id,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE hit IS NULL), '') AS text,
  count(*) AS n_lines, count(hit) AS n_dropped
FROM each LEFT JOIN frequent USING (host, line) GROUP BY doc_id
"""


@query("op3_site_lines", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return boilerplate.drop_boilerplate(docs).drop("source")


@query("op4_simhash_groups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.drop_repeats(documents(spark, sf_dir, "doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query("op6_packed_windows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir, "doc_id", "text"))


@query("op7_near_vectors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.add_candidates(documents(spark, sf_dir, "doc_id", "text"))
    found = materialise(found.select("doc_id", "candidates"), "candidates")
    model = pii.fit(found)
    base = F.filter("candidates", lambda c: c["base"])
    counts = [
        F.size(pii.of_kind(base, kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(pii.accepted(model)).alias("spans"),
    )


@query("op9_chat_examples")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    examples = chat.expand(turns.select(*extra.columns).unionByName(extra))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    turn = F.transform(
        chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    last = F.col("example") == F.col("n_turns")
    each = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("loss"),
        F.char_length("formatted").alias("chars"),
        F.when(last, turn).alias("turns"),
    ).select(
        "conv_id",
        "loss",
        "chars",
        F.size("turns").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
    )
    text = F.array_join(F.transform(F.sort_array("loss"), lambda x: x["loss"]), "")
    grouped = each.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.collect_list("loss").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.withColumn("loss", text).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER)
    AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))


WORDS_SQL = """
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS tf FROM found WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS code FROM counted),
hashed AS (
  SELECT run, tf, xor(list_reduce(
    list_transform(range(0, length(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM coded, bytes),
cut AS (
  SELECT tf, CASE WHEN h % 199 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(tf) AS BIGINT) AS n FROM cut
  WHERE length(word) >= 6 GROUP BY word HAVING sum(tf) >= 5),
shorter AS (
  SELECT word, n, i AS place, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chains AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@query("op12_spelling_variants", WORDS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(documents(spark, sf_dir, "doc_id", "text")))


WARC_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload, sha1(payload) AS hex FROM bodies),
marked AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id,
    translate(array_to_string(list_transform(range(0, 8),
      lambda i: to_base(CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT), 32, 4)), ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM digests)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM marked
"""


@query("op13_warc_archive", WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.archive(pages), path)
    return warc.resolve(materialise(warc.read_warc(spark, path, payloads=False).drop("header"), "records_read"))
