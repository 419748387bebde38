"""TF-IDF in long form: one row per document and term.

The vocabulary is unbounded (all word 1- to 3-grams of the training split), so
it stays a distributed table; nothing is collected and no vector is as wide as
the vocabulary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from textassay.functions.text import count_repeats, ngrams, terms
from textassay.operators.grams import (
    ROWS,
    blocks_of,
    count_grams,
    dealt,
    in_batches,
    pack,
    pack_terms,
    parts_for,
    term_counts,
    unpack,
    unpack_terms,
    word_total,
)
from textassay.operators.joins import hot_keys
from textassay.session import materialise, shuffle_partitions


def document_terms(df: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """``df`` with its filtered word array ``terms`` in place of the text.

    Only the words are kept; their n-grams, several times as large, are formed
    where they are counted.
    """
    return df.withColumn("terms", terms(F.col(text), **kwargs)).drop(text)


def term_frequencies(docs: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``(key, *keep, term, tf)``, counted inside each row: no shuffle."""
    counted = docs.select(key, *keep, F.inline_outer(count_repeats(ngrams(F.col("terms")))))
    return counted.where(F.col("term").isNotNull())


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary ``(term, df, idf)`` and the frequent terms to be salted."""

    vocabulary: DataFrame
    hot: DataFrame | None


def document_frequencies(docs: DataFrame, min_df: int = 1) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1+n)/(1+df)) + 1.

    ``n`` counts every document, also those without terms.
    """
    n, words = word_total(docs)
    counted = term_counts(docs, parts_for(docs, 3 * words)).where(F.col("df") >= min_df)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    return counted.withColumn("idf", idf)


def fit_tfidf(
    train_docs: DataFrame, min_df: int = 1, hot_limit: int | None = None
) -> TfidfModel:
    """Fit on training documents only (rows with a ``terms`` array)."""
    vocabulary = materialise(document_frequencies(train_docs, min_df), "tfidf_vocabulary")
    return TfidfModel(vocabulary, hot_keys(vocabulary, "term", "df", limit=hot_limit))


KINDS = "p int, b bigint, terms binary, idf binary"
VOCABULARY = -1  # in place of a block's number


def _blocks(docs: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """``(b, words, body)``: rows of ``docs`` with their words, packed to blocks that hold all rows of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        for b, block in enumerate(blocks_of(batches, "_terms", "_key")):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(block)
            words = len(block.column("_terms").chunk(0).flatten())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + b], pa.int64()), pa.array([words], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["b", "words", "body"],
            )

    spark = docs.sparkSession
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    named = docs.select(F.col(key).alias("_key"), *keep, F.col("terms").alias("_terms"))
    sorted_ = named.repartition(tasks, "_key").sortWithinPartitions("_key")
    return materialise(sorted_.mapInArrow(run, "b bigint, words bigint, body binary"), "term_blocks")


def _opened(body) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()


def _weighted(docs: DataFrame, model: TfidfModel, key: str, keep: Sequence[str], emit: Callable, schema: StructType) -> DataFrame:
    """What ``emit(block, terms, idf, row, term, times)`` makes of every block of ``docs``; ``idf`` is NaN for unknown terms.

    A block asks each part of the vocabulary for its distinct terms once and is answered with their idf, in the order of
    the question. The terms are not sent back and not stored: the block forms them again.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, key, keep)
    words = blocks.agg(F.sum("words").alias("n")).first()["n"] or 0
    parts = parts_for(docs, max(3 * words, model.vocabulary.count()))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            names, idf = table.column("term").chunk(0).cast(pa.string()), table.column("idf").to_numpy()
            for p, at in dealt(names, parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([VOCABULARY], pa.int64()),
                     pa.array([pack_terms(names.take(pa.array(at)))], pa.binary()), pa.array([pack(idf[at])], pa.binary())],
                    names=["p", "b", "terms", "idf"],
                )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= 8 * ROWS:
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, body in zip(batch.column("b"), batch.column("body")):
                names, *_ = count_grams(_opened(body).column("_terms").chunk(0))
                for p, at in dealt(names, parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([b.as_py()], pa.int64()),
                         pa.array([pack_terms(names.take(pa.array(at)))], pa.binary()), pa.array([None], pa.binary())],
                        names=["p", "b", "terms", "idf"],
                    )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list] = {}
        questions: dict[int, list] = {}
        for batch in batches:
            for p, b, names, idf in zip(*(batch.column(c) for c in ("p", "b", "terms", "idf"))):
                p, b, names = p.as_py(), b.as_py(), unpack_terms(names)
                if b == VOCABULARY:
                    tables.setdefault(p, []).append((names, unpack(idf, np.float64)))
                else:
                    questions.setdefault(p, []).append((b, names))
        for p, each in questions.items():
            held = tables.get(p, [(pa.array([], pa.string()), np.zeros(0))])
            values = np.append(np.concatenate([idf for _, idf in held]), np.nan)
            every = pa.concat_arrays([names for _, names in each])
            at = pc.index_in(every, pa.concat_arrays([names for names, _ in held])).fill_null(-1).to_numpy()
            found, start = values[at], 0
            for b, names in each:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int64()), pa.array([p], pa.int32()), pa.array([pack(found[start : start + len(names)])], pa.binary())],
                    names=["b", "p", "body"],
                )
                start += len(names)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, answers = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            names, row, term, times = count_grams(block.column("_terms").chunk(0))
            idf = np.full(len(names), np.nan)
            for (_, at), found in zip(dealt(names, parts), answers, strict=True):
                idf[at] = found
            yield from emit(block, names, idf, row, term, times)

        for batch in batches:
            for b, p, body in zip(*(batch.column(c) for c in ("b", "p", "body"))):
                if p.as_py() >= 0:
                    answers.append(unpack(body, np.float64))
                    continue
                if block is not None:
                    yield from done()
                block, answers = _opened(body), []
        if block is not None:
            yield from done()

    table = model.vocabulary.select("term", "idf").mapInArrow(known, KINDS)
    asked_for = blocks.select("b", "body").mapInArrow(asked, KINDS)
    answers = table.union(asked_for).repartitionById(parts, "p").mapInArrow(answered, "b bigint, p int, body binary")
    whole = blocks.select("b", F.lit(-1).alias("p"), "body").union(answers)
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return whole.repartition(tasks, "b").sortWithinPartitions("b", "p").mapInArrow(emitted, schema)


def _squares(block: pa.Table, idf: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray):
    """Which of a block's entries are of known terms, their weights, the group of equal keys of each row, its squared length."""
    weight = times * idf[term]
    known = ~np.isnan(weight)
    weight, row = weight[known], row[known]
    group = block.column("_key").chunk(0).dictionary_encode("encode").indices.to_numpy()
    return known, weight, group, np.bincount(group[row], weights=weight * weight, minlength=int(group.max(initial=-1)) + 1)


def transform_tfidf(
    docs: DataFrame, model: TfidfModel, key: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, *keep, term, tfidf)`` with each document scaled to L2 norm 1.

    Terms outside the vocabulary are left out. Narrow columns of the document that the result needs travel with it as
    ``keep``. Rows of one key are one document.
    """
    fields = {f.name: f for f in docs.select(key, *keep).schema}
    schema = StructType([fields[key], *[fields[c] for c in keep]]).add("term", StringType()).add("tfidf", DoubleType())

    def emit(block, names, idf, row, term, times) -> Iterator[pa.RecordBatch]:
        known, weight, group, squares = _squares(block, idf, row, term, times)
        row, value = row[known], weight / np.sqrt(squares[group[row[known]]])
        code = term[known]
        for start in range(0, len(row), ROWS):
            at, part = pa.array(row[start : start + ROWS]), slice(start, start + ROWS)
            columns = [block.column(c).chunk(0).take(at) for c in ("_key", *keep)]
            columns += [names.take(pa.array(code[part])), pa.array(value[part])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _weighted(docs, model, key, keep, emit, schema)


def l2_normalise(df: DataFrame, values: str = "embedding") -> DataFrame:
    """Scale a dense array column to L2 norm 1 (an all-zero row stays as it is)."""
    doubles = F.col(values).cast("array<double>")
    squares = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x)
    norm = F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))
    return df.withColumn("_norm", norm).withColumn(
        values, F.transform(doubles, lambda x: x / F.col("_norm"))
    ).drop("_norm")


def document_norms(docs: DataFrame, model: TfidfModel, key: str = "doc_id") -> DataFrame:
    """``(key, norm)``: length of each document's unscaled TF-IDF vector; documents without known terms are left out."""
    schema = StructType([docs.schema[key]]).add("norm", DoubleType())

    def emit(block, names, idf, row, term, times) -> Iterator[pa.RecordBatch]:
        known, _, group, squares = _squares(block, idf, row, term, times)
        first = np.unique(group, return_index=True)[1]
        some = np.bincount(group[row[known]], minlength=len(squares)) > 0
        keys = block.column("_key").chunk(0).take(pa.array(first[some]))
        yield from in_batches([keys, pa.array(np.sqrt(squares[some]))], schema.names)

    return _weighted(docs, model, key, (), emit, schema)


def save_tfidf(model: TfidfModel, path: str, buckets: int | None = None) -> None:
    """Store a fitted vectoriser below ``path``: its vocabulary in buckets of terms, its frequent terms, a manifest.

    The manifest is written last, so half a model is never loaded. A bucketed vocabulary is joined without being
    shuffled. ``buckets`` defaults to the shuffle partitions.
    """
    spark = model.vocabulary.sparkSession
    buckets = buckets or shuffle_partitions(spark)
    # a table name is the only way to buckets; the files are at ``path`` and the name goes again
    name = f"tfidf_{uuid.uuid4().hex}"
    columns = model.vocabulary.select("term", "df", "idf")
    columns.write.option("path", f"{path}/vocabulary").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    if model.hot is not None:
        model.hot.write.mode("overwrite").parquet(f"{path}/hot")
    manifest = spark.createDataFrame([(FORMAT, buckets, model.hot is not None)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


FORMAT = 1
MANIFEST = "format int, buckets int, hot boolean"


def load_tfidf(spark: SparkSession, path: str) -> TfidfModel:
    """The vectoriser saved at ``path``; its vocabulary knows its buckets."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if manifest is None or manifest["format"] != FORMAT:
        raise ValueError(f"no vectoriser of format {FORMAT} at {path}")
    name = f"tfidf_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (term STRING, df BIGINT, idf DOUBLE) USING parquet "
        f"CLUSTERED BY (term) SORTED BY (term) INTO {manifest['buckets']} BUCKETS LOCATION '{place}/vocabulary'"
    )
    hot = spark.read.schema("term string, _salts int").parquet(f"{path}/hot") if manifest["hot"] else None
    return TfidfModel(spark.table(name), hot)
