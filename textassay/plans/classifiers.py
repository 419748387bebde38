"""The three binary classifiers, batch scoring and model persistence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, VectorAssembler, Word2Vec
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.text import clean_text, sequence_words
from textassay.operators import metrics
from textassay.session import materialise


def logistic_regression(n_rows: int, c: float = 1.0, max_iter: int = 200, **kwargs) -> LogisticRegression:
    """L2 logistic regression with inverse strength ``c``.

    Spark averages the loss over the rows, so the equal penalty is 1/(c * n).
    """
    return LogisticRegression(
        maxIter=max_iter,
        regParam=1.0 / (c * max(n_rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
        **kwargs,
    )


def random_forest(
    trees: int = 100, max_depth: int = 10, min_leaf: int = 2, seed: int = 42, **kwargs
) -> RandomForestClassifier:
    """Two leaves of two rows imply four rows before a split."""
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        seed=seed,
        **kwargs,
    )


TREE_TASK_BYTES = 512 << 20  # of binned columns in one task of a forest, about
FEW_TREE_BYTES = 32 << 20  # up to here a forest has few nodes, and its rows stay where they are


def tree_rows(train: DataFrame, n_rows: int, width: int, fits: int = 1) -> DataFrame:
    """``train`` in as many partitions as pay for a forest over ``width`` columns, with ``fits`` forests at a time.

    In every pass each partition holds, sends and merges the statistics of all nodes of the pass (up to 256 MB),
    however few its rows are: work grows with partitions times nodes. So a forest gets its share of the cores, two
    partitions at least, and more only where the rows of a task would take over ``TREE_TASK_BYTES`` (a tree learner
    keeps four bytes a column). Rows are not shuffled. The draws of a forest depend on the partitions, as before.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    row_bytes = n_rows * width * 4
    if row_bytes <= FEW_TREE_BYTES:
        return train
    by_size = -(-row_bytes // TREE_TASK_BYTES)
    return train.coalesce(max(2, cores // fits, by_size))


# --- sequence classifier ------------------------------------------------------


def sequence_input(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words``, the sequence of the cleaned text, which the model reads."""
    return df.withColumn("words", sequence_words(clean_text(F.col(text))))


SHARE_ROWS = 50_000
MEANING_STAGES = 2  # of the model: the buckets of the words and their vectors


def fit_sequence_model(
    train: DataFrame,
    vector_size: int = 128,
    hashed_width: int = 1 << 14,
    reg_param: float = 1e-4,
    max_iter: int = 30,
    class_weight: bool = True,
    buckets: int = 1 << 17,
    partitions: int | None = None,
    seed: int = 42,
    meaning: Sequence[Transformer] | None = None,
) -> PipelineModel:
    """Word vectors plus hashed words and word pairs, weighted logistic regression.

    A Spark-native stand-in for a recurrent network: word pairs carry the local
    order. ``train`` has ``words`` and ``label``. Every word enters both parts: its
    vector is that of one of ``buckets`` hash buckets, which bounds what the driver
    holds to ``buckets * vector_size`` numbers whatever the data. The vectors are
    averaged over ``partitions`` shares of the rows, by default one for 50,000 rows and eight at least.
    ``meaning`` are the first ``MEANING_STAGES`` stages of a model fitted before on the same rows with the same
    ``vector_size``, ``buckets``, ``partitions`` and ``seed``; their vectors are then not learnt again.
    """
    if class_weight:
        weights = materialise(metrics.class_weights(train), "class_weights")
        train = train.join(weights, "label")
    else:
        train = train.withColumn("weight", F.lit(1.0))
    if meaning is None:
        meaning = [
            SQLTransformer(
                statement="SELECT *, transform(words, w -> "
                f"CAST(pmod(xxhash64(w), {buckets}L) AS STRING)) AS _buckets FROM __THIS__"
            ),
            Word2Vec(
                inputCol="_buckets",
                outputCol="_meaning",
                vectorSize=vector_size,
                minCount=0,
                numPartitions=partitions or max(8, -(-train.count() // SHARE_ROWS)),
                seed=seed,
            ),
        ]
    stages = [
        *meaning,
        NGram(n=2, inputCol="words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(words, _pairs) AS _grams FROM __THIS__"),
        HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=hashed_width, binary=True),
        VectorAssembler(inputCols=["_meaning", "_hashed"], outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=reg_param, weightCol="weight"),
    ]
    return Pipeline(stages=stages).fit(train)


# --- persistence --------------------------------------------------------------


def _is_saved(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException:
        return False
    return True


def input_state(*tables: DataFrame) -> str:
    """Digest of path, size and time of the files that ``tables`` are read from.

    For the configuration of a saved model: rewritten tables in the same folder
    are other data. ``tables`` are plain scans; a job over their files' metadata
    adds up two hashes per file, so the driver sees one row per table.
    """
    seen = []
    for df in tables:
        file = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        each = F.sha2(F.to_json(F.struct(*file.columns)), 256)
        halves = [F.conv(F.substring(each, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
        seen.append([str(x) for x in file.agg(F.count("*"), *map(F.sum, halves)).first()])
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def model_path(root: str, config: dict) -> str:
    """Holds a digest of ``config``: a model of other settings is never picked up."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/model-{digest}"


def load_or_fit(
    spark: SparkSession, root: str, config: dict, fit: Callable[[], PipelineModel]
) -> PipelineModel:
    """The saved model of this configuration, or a new one, fitted and saved."""
    path = model_path(root, config)
    if not _is_saved(spark, path):
        fit().write().overwrite().save(path)
    return PipelineModel.load(path)


def feature_importance(forest, terms: DataFrame, k: int = 30) -> DataFrame:
    """``(term, importance, n_terms)`` of the ``k`` most important columns of a forest.

    ``terms`` is the ``(bucket, term, df)`` table of the forest's named vectors. A
    column shared by ``n_terms`` terms goes by the most frequent one (of equals, the
    last by name). Columns that no tree uses are left out.
    """
    found = forest.featureImportances  # as long as the vectors are wide, a parameter
    rows = [(int(i), float(x)) for i, x in zip(found.indices, found.values, strict=True)]
    used = terms.sparkSession.createDataFrame(rows, "bucket long, importance double")
    top = used.orderBy(F.desc("importance"), F.asc("bucket")).limit(k)
    named = terms.join(F.broadcast(top), "bucket").groupBy("bucket").agg(
        F.max_by("term", F.struct("df", "term")).alias("term"),
        F.first("importance").alias("importance"),
        F.count("*").alias("n_terms"),
    )
    return named.drop("bucket").orderBy(F.desc("importance"), F.asc("term"))


def term_importance(forest, names: list[str], spark: SparkSession, k: int = 30) -> DataFrame:
    """``(term, importance)`` of the ``k`` terms that a forest over named terms uses most; unused ones are left out."""
    found = forest.featureImportances  # as long as the list of selected terms
    rows = [(names[i], float(x)) for i, x in zip(found.indices, found.values, strict=True)]
    table = spark.createDataFrame(rows, "term string, importance double")
    return table.orderBy(F.desc("importance"), F.asc("term")).limit(k)
