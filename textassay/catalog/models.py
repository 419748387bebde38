"""Fitted models over the labelled documents; what SQL can state of them is in :mod:`textassay.catalog.properties`."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textassay.catalog.base import labelled, query, split_labelled, table
from textassay.operators import metrics, splits
from textassay.operators.tfidf import l2_normalise
from textassay.plans import classifiers, evaluation, projection, tuning
from textassay.plans.features import (
    HASHED_WIDTH,
    NAMED_WIDTH,
    PLANE_WIDTH,
    fit_vectors,
    term_buckets,
)
from textassay.session import app_dir, materialise, scratch_path
from textassay.sources import features as feature_files
from textassay.sources.reports import training_history, write_report


IN_TRAIN = "split = 'train'"


def split_vectors(spark, sf_dir, **kwargs):
    """Text model and the path of its feature table, one folder per split."""
    keep = ("doc_id", "split", "label")
    model, rows = fit_vectors(split_labelled(spark, sf_dir), keep, IN_TRAIN, **kwargs)
    path = scratch_path(spark, "vectors")
    feature_files.write_features(rows, path)
    return model, path


def input_state(spark, sf_dir) -> str:
    return classifiers.input_state(*[table(spark, sf_dir, t) for t in ("documents", "labels")])


def fitted_regression(spark, sf_dir):
    """The regression on its feature table, fitted once per application and state of the tables."""
    root = f"{app_dir(spark)}/models"
    config = {
        "model": "logistic_regression",
        "c": 1.0,
        "max_iter": 200,
        "width": HASHED_WIDTH,
        "data": input_state(spark, sf_dir),
    }

    def fit() -> PipelineModel:
        features, path = split_vectors(spark, sf_dir)
        train = feature_files.load_features(spark, path, "train")
        fitted = classifiers.logistic_regression(train.count()).fit(train)
        write_report(training_history(spark, fitted), history_path(root, config))
        return PipelineModel([*features.stages, fitted])

    return classifiers.load_or_fit(spark, root, config, fit), history_path(root, config)


def fitted_forest(spark, sf_dir):
    """The forest on named vectors, fitted once per application and state of the tables."""
    config = {
        "model": "random_forest",
        "trees": 100,
        "max_depth": 10,
        "min_leaf": 2,
        "seed": 42,
        "width": NAMED_WIDTH,
        "data": input_state(spark, sf_dir),
    }

    def fit() -> PipelineModel:
        features, path = split_vectors(spark, sf_dir, width=NAMED_WIDTH, named=True)
        train = feature_files.load_features(spark, path, "train")
        train = classifiers.tree_rows(train, train.count(), NAMED_WIDTH)
        return PipelineModel([*features.stages, classifiers.random_forest().fit(train)])

    return classifiers.load_or_fit(spark, f"{app_dir(spark)}/models", config, fit)


def history_path(root: str, config: dict) -> str:
    return f"{classifiers.model_path(root, config)}-history"


def held_out(spark, sf_dir):
    return split_labelled(spark, sf_dir).where("split <> 'train'")


@query("logistic_regression")
def logistic_regression(spark, sf_dir):
    """Validation and test measures of the TF-IDF logistic regression."""
    model, _ = fitted_regression(spark, sf_dir)
    scores = evaluation.score(model, held_out(spark, sf_dir), ("doc_id", "split", "label"))
    return metrics.binary_summary(scores, ["split"])


@query("training_history")
def history(spark, sf_dir):
    _, path = fitted_regression(spark, sf_dir)
    return spark.read.schema("iteration int, objective double").json(path)


@query("regression_scores")
def regression_scores(spark, sf_dir):
    """Class and probability of every labelled document, from the saved model."""
    model, _ = fitted_regression(spark, sf_dir)
    return evaluation.score(model, labelled(spark, sf_dir))


@query("regression_evaluation")
def regression_evaluation(spark, sf_dir):
    model, _ = fitted_regression(spark, sf_dir)
    return evaluation.evaluate_model(model, held_out(spark, sf_dir).where("split = 'test'"))


@query("forest_importance")
def forest_importance(spark, sf_dir):
    """The columns that the forest uses most, by their most frequent training term."""
    forest = fitted_forest(spark, sf_dir).stages[-1]
    terms = term_buckets(split_labelled(spark, sf_dir).where(IN_TRAIN))
    return classifiers.feature_importance(forest, terms)


@query("forest_evaluation")
def forest_evaluation(spark, sf_dir):
    """The saved forest on the test rows, from text to scores."""
    test = held_out(spark, sf_dir).where("split = 'test'")
    return metrics.classification_report(evaluation.score(fitted_forest(spark, sf_dir), test))


@query("tree_count_sweep")
def tree_count_sweep(spark, sf_dir):
    """RMSE by number of trees, trained on a fifth of the rows."""
    rows = splits.holdout_split(labelled(spark, sf_dir))
    keep = ("doc_id", "split", "label")
    _, vectors = fit_vectors(rows, keep, IN_TRAIN, NAMED_WIDTH, named=True)
    return tuning.tree_count_sweep(vectors.where(IN_TRAIN), vectors.where("split = 'val'"), width=NAMED_WIDTH)


@query("learning_curve")
def learning_curve(spark, sf_dir):
    """F1 of the forest by share of the training rows, over five folds."""
    rows = splits.folds(labelled(spark, sf_dir))
    keep = ("fold", "step", "label")
    _, vectors = fit_vectors(rows, keep, width=NAMED_WIDTH, named=True)
    return tuning.learning_curve(vectors, classifiers.random_forest(), parallelism=8, width=NAMED_WIDTH)


def split_words(spark, sf_dir):
    rows = classifiers.sequence_input(split_labelled(spark, sf_dir)).drop("text")
    return materialise(rows.where(F.size("words") > 0), "split_words")


@query("sequence_classifier")
def sequence_classifier(spark, sf_dir):
    """Threshold chosen on validation scores, measured on the test split."""
    rows = split_words(spark, sf_dir)
    model = classifiers.fit_sequence_model(rows.where("split = 'train'"))
    val, test = (
        materialise(evaluation.score(model, rows.where(F.col("split") == s)), "scores")
        for s in ("val", "test")
    )
    return evaluation.final_test(val, test)


@query("parameter_search")
def parameter_search(spark, sf_dir):
    """Best of twelve random trials of the sequence classifier, saved and measured on the test split."""
    rows = split_words(spark, sf_dir)
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    results, paths = tuning.search(train, val, parallelism=1, folder=scratch_path(spark, "trials"))
    best = PipelineModel.load(tuning.best_model(results, paths))
    scores = [materialise(evaluation.score(best, part), "scores") for part in (val, test)]
    measured = evaluation.final_test(*scores).first()
    return tuning.best_trial(results).withColumns(
        {name: F.lit(measured[name]) for name in ("test_auc", "test_accuracy")}
    )


@query("cluster_quality")
def cluster_quality(spark, sf_dir):
    rows = l2_normalise(table(spark, sf_dir, "embeddings"))
    return projection.cluster_quality(projection.dense_features(rows), k=10)


@query("document_plane")
def document_plane(spark, sf_dir):
    """Balanced sample of the training split in its first two singular directions."""
    _, path = split_vectors(spark, sf_dir, width=PLANE_WIDTH)
    train = feature_files.load_features(spark, path, "train").select("doc_id", "label", "features")
    sample = materialise(splits.balanced_sample(train), "balanced")
    plane = projection.plane(projection.truncated_svd(sample))
    return plane.join(sample.select("doc_id", "label"), "doc_id")


@query("document_coordinates")
def document_coordinates(spark, sf_dir):
    """Every document in the first hundred singular directions of all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    _, rows = fit_vectors(docs, ("doc_id",), width=PLANE_WIDTH)
    return projection.truncated_svd(rows)
