"""Text to TF-IDF vectors as Spark ML stages, for models and for streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    Interaction,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.functions.stopwords import ENGLISH
from textassay.functions.text import TERM_PATTERN, ngrams
from textassay.operators.tfidf import TfidfModel, document_norms
from textassay.session import materialise

HASHED_WIDTH = 1 << 18
NAMED_WIDTH = 1 << 12  # tree learners store rows densely: 16 kB a row
PLANE_WIDTH = 1 << 12  # the SVD then takes one pass and a sum of 134 MB a task, not a pass a step


def term_stages(text: str = "text") -> list[Transformer]:
    """Words, stop words out, then 1- to 3-grams, as column ``_terms``."""
    return [
        RegexTokenizer(
            inputCol=text, outputCol="_tokens", pattern=TERM_PATTERN, gaps=False, toLowercase=True
        ),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=ENGLISH),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        NGram(n=3, inputCol="_words", outputCol="_triples"),
        SQLTransformer(
            statement="SELECT *, concat(_words, _pairs, _triples) AS _terms FROM __THIS__"
        ),
    ]


def bucket_of(term: Column, width: int) -> Column:
    """Column number of a term in ``named`` vectors."""
    return F.pmod(F.xxhash64(term), F.lit(width))


def named_counter(width: int) -> list[Transformer]:
    """Counts by :func:`bucket_of`, which a table of terms can be joined to."""
    buckets = SQLTransformer(
        statement=f"SELECT *, transform(_terms, t -> CAST(pmod(xxhash64(t), {width}L) AS STRING))"
        " AS _buckets FROM __THIS__"
    )
    numbers = [str(i) for i in range(width)]
    return [buckets, CountVectorizerModel.from_vocabulary(numbers, "_buckets", "_counts")]


def term_buckets(df: DataFrame, width: int = NAMED_WIDTH, text: str = "text") -> DataFrame:
    """``(bucket, term, df)`` of every term of ``df``."""
    terms = PipelineModel(term_stages(text)).transform(df)
    counted = terms.select(F.explode(F.array_distinct("_terms")).alias("term"))
    counted = counted.groupBy("term").agg(F.count("*").alias("df"))
    return counted.select(bucket_of(F.col("term"), width).alias("bucket"), "term", "df")


def fit_vectors(
    df: DataFrame,
    keep: Sequence[str],
    train: Column | str | None = None,
    width: int = HASHED_WIDTH,
    named: bool = False,
    text: str = "text",
) -> tuple[PipelineModel, DataFrame]:
    """L2-normalised TF-IDF vectors ``features`` of all rows, fitted on ``train`` rows.

    Every term is hashed to one of ``width`` columns, none is left out; with
    ``named`` the columns are the buckets of :func:`term_buckets`. The width, and
    with it what the driver holds, is a parameter and not a property of the data.

    The text is read once: the term counts are stored, and the idf and the
    vectors come from them. The returned model goes from text to ``features``,
    the returned rows have ``keep`` and ``features``.
    """
    stages = term_stages(text)
    if named:
        stages += named_counter(width)
    else:
        stages.append(HashingTF(numFeatures=width, inputCol="_terms", outputCol="_counts"))
    counted = PipelineModel(stages).transform(df).select(*keep, "_counts")
    counted = materialise(counted, "term_counts")
    fitted = IDF(inputCol="_counts", outputCol="_idf").fit(
        counted if train is None else counted.where(train)
    )
    # the idf wanted is ln((1+n)/(1+df)) + 1; the fitted one lacks the 1
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense(fitted.idf.toArray() + 1.0),
        inputCol="_counts",
        outputCol="_weighted",
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
    rows = PipelineModel([weights, unit]).transform(counted).select(*keep, "features")
    return PipelineModel([*stages, weights, unit]), rows


def selected_vectors(
    docs: DataFrame, vectoriser: TfidfModel, selected: DataFrame, keep: Sequence[str], key: str = "doc_id"
) -> tuple[list[str], DataFrame]:
    """The selected terms in column order, and ``keep`` with ``features``: their TF-IDF, scaled by whole documents.

    ``docs`` has a ``terms`` array; ``selected`` is a bounded table of terms (see
    :func:`textassay.operators.selection.select_terms`). Vectors are sparse and made in the JVM; a
    document's length is that over all terms, not over the selected ones.
    """
    known = selected.join(vectoriser.vocabulary.select("term", "idf"), "term").orderBy("term").collect()
    names = [r["term"] for r in known]
    norms = materialise(document_norms(docs, vectoriser, key), "norms")
    scale = F.coalesce(F.lit(1.0) / F.col("norm"), F.lit(0.0))
    rows = docs.join(norms, key, "left").select(
        *keep, ngrams(F.col("terms")).alias("_terms"), scale.alias("_scale")
    )
    stages = [
        CountVectorizerModel.from_vocabulary(names, "_terms", "_counts"),
        Interaction(inputCols=["_scale", "_counts"], outputCol="_scaled"),
        ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="_scaled", outputCol="features"
        ),
    ]
    return names, PipelineModel(stages).transform(rows).select(*keep, "features")
