from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from textassay.operators import splits, tfidf
from textassay.plans import classifiers, evaluation, preprocess, projection, tuning
from textassay.plans.features import fit_vectors, term_buckets


@pytest.fixture(scope="module")
def claims(spark):
    """Two easily told apart classes."""
    i = F.col("id")
    word = F.when(i % 2 == 1, F.concat(F.lit("miracle cure number"), i % 5)).otherwise(
        F.concat(F.lit("council budget report"), i % 7)
    )
    return spark.range(120).select(
        i.alias("doc_id"), word.alias("text"), (i % 2).cast("int").alias("label")
    )


def test_vectors_equal_the_long_form(spark, claims):
    model, stored = fit_vectors(claims, ["doc_id"], width=1 << 14, named=True)
    names = {r["bucket"]: r["term"] for r in term_buckets(claims, 1 << 14).collect()}
    again = model.transform(claims).select("doc_id", "features")
    assert sorted(map(str, stored.collect())) == sorted(map(str, again.collect()))
    wide = {}
    for r in stored.collect():
        for j, v in zip(r["features"].indices, r["features"].values):
            wide[(r["doc_id"], names[j])] = round(float(v), 9)
    docs = tfidf.document_terms(claims)
    long_form = tfidf.transform_tfidf(docs, tfidf.fit_tfidf(docs))
    assert wide == {(r[0], r[1]): round(r[2], 9) for r in long_form.collect()}


def test_regression_learns_and_reloads(spark, claims, tmp_path):
    rows = splits.stratified_split(claims)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    calls = []

    def fit():
        calls.append(1)
        features, rows = fit_vectors(train, ["label"], width=1 << 10)
        fitted = classifiers.logistic_regression(train.count()).fit(rows)
        return PipelineModel([*features.stages, fitted])

    root = str(tmp_path)
    model = classifiers.load_or_fit(spark, root, {"c": 1}, fit)
    again = classifiers.load_or_fit(spark, root, {"c": 1}, fit)
    assert calls == [1]
    classifiers.load_or_fit(spark, root, {"c": 2}, fit)
    assert calls == [1, 1]
    scores = [sorted(map(tuple, evaluation.score(m, test).collect())) for m in (model, again)]
    assert scores[0] == scores[1]
    quality = evaluation.evaluate_model(model, test).first()
    assert quality["auc"] == 1.0 and quality["accuracy"] == 1.0


def test_forest_sweep_and_importance(spark, claims):
    rows = splits.holdout_split(claims)
    _, stored = fit_vectors(
        rows, ["doc_id", "split", "label"], F.col("split") == "train", 64, named=True
    )
    train, rest = stored.where("split = 'train'"), stored.where("split = 'val'")
    sweep = {r["trees"]: r["rmse"] for r in tuning.tree_count_sweep(train, rest, (2, 5), 4).collect()}
    assert set(sweep) == {2, 5} and all(0 <= v < 0.5 for v in sweep.values())
    forest = classifiers.random_forest(5, 4).fit(train)
    terms = term_buckets(rows.where("split = 'train'"), 64)
    top = classifiers.feature_importance(forest, terms, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]
    everything = classifiers.feature_importance(forest, terms, 64).collect()
    assert sum(r["importance"] for r in everything) == pytest.approx(1.0)


def test_sequence_model_search(spark, claims):
    rows = classifiers.sequence_input(splits.stratified_split(claims)).drop("text")
    space = {"vector_size": [4], "hashed_width": [64, 128], "max_iter": [5]}
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    results, models = tuning.search(train, val, space, mode="grid", trials=2)
    assert results.count() == 2 == len(models)
    best = tuning.best_trial(results).first()
    assert best["val_auc"] == 1.0 and best["hashed_width"] == 64
    assert tuning.best_model(results, models) is models[best["trial"] - 1]
    val_scores, test_scores = (
        evaluation.score(models[0], rows.where(F.col("split") == s)) for s in ("val", "test")
    )
    final = evaluation.final_test(val_scores, test_scores).first()
    assert final["test_auc"] == 1.0 and final["val_best_f1"] == 1.0


def test_search_saves_its_models_and_learns_vectors_once(spark, claims, tmp_path, monkeypatch):
    """Paths in the order of the trials, one set of word vectors a size, all of a size with equal ones; models like those fitted alone."""
    rows = classifiers.sequence_input(splits.stratified_split(claims)).drop("text")
    train, val = (rows.where(F.col("split") == s).cache() for s in ("train", "val"))
    learnt, fit = [], classifiers.Word2Vec._fit
    monkeypatch.setattr(classifiers.Word2Vec, "_fit", lambda self, df: learnt.append(self.getVectorSize()) or fit(self, df))
    space = {"hashed_width": [64, 128], "max_iter": [5], "vector_size": [3, 4]}
    results, paths = tuning.search(train, val, space, "grid", 4, parallelism=1, folder=f"file://{tmp_path}/trials")
    assert sorted(learnt) == [3, 4] and len(paths) == 4 and all(isinstance(p, str) for p in paths)
    held: dict[int, list] = {}
    for row, path in zip(results.orderBy("trial").collect(), paths, strict=True):
        model = PipelineModel.load(path)
        assert model.stages[1].getVectorSize() == row["vector_size"]
        assert model.stages[4].getNumFeatures() == row["hashed_width"]
        vectors = {r["word"]: tuple(r["vector"]) for r in model.stages[1].getVectors().collect()}
        assert held.setdefault(row["vector_size"], vectors) == vectors
        alone = classifiers.fit_sequence_model(train, row["vector_size"], row["hashed_width"], max_iter=5)
        got, want = ({r["doc_id"]: r["prob"] for r in evaluation.score(m, val).collect()} for m in (model, alone))
        assert got == pytest.approx(want, abs=0.02)  # vectors differ a little from fit to fit
    assert tuning.best_model(results, paths) in paths


def test_draws(spark):
    space = {"a": [1, 2], "b": ["x", "y"]}
    assert tuning.draw_trials(spark, space, "grid", 3, 0) == [
        {"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}]
    drawn = tuning.draw_trials(spark, space, "random", 5, 1)
    assert drawn == tuning.draw_trials(spark, space, "random", 5, 1) and len(drawn) == 5
    with pytest.raises(ValueError, match="unknown mode"):
        tuning.draw_trials(spark, space, "other", 1, 1)


def test_no_word_and_no_term_is_left_out(spark):
    """A flat vocabulary, every word seen once, in both kinds of model."""
    rows = [(i, f"alpha{i} beta{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert term_buckets(df, 16).agg(F.sum("df")).first()[0] == 120
    _, vectors = fit_vectors(df, ["doc_id"], width=16, named=True)
    assert all(r["features"].numNonzeros() for r in vectors.collect())
    words = classifiers.sequence_input(df).drop("text")
    model = classifiers.fit_sequence_model(words, 4, 64, max_iter=2, buckets=1 << 20, partitions=2)
    assert model.stages[1].getVectors().count() == 80


def test_rewritten_data_is_other_data(spark, tmp_path):
    path = str(tmp_path / "t")
    states = []
    for n in (5, 5, 6):
        spark.range(n).write.mode("overwrite").parquet(path)
        states.append(classifiers.input_state(spark.read.parquet(path)))
    assert len(set(states)) == 3
    assert classifiers.input_state(spark.read.parquet(path)) == states[-1]


def test_learning_curve(spark, claims):
    rows = splits.folds(claims)
    _, stored = fit_vectors(rows, ["fold", "step", "label"], width=64, named=True)
    curve = tuning.learning_curve(stored.cache(), classifiers.logistic_regression(120), 2, 10)
    got = {r["step"]: r["validation_mean"] for r in curve.collect()}
    assert set(got) == set(range(1, 11)) and got[10] > 0.9


def test_truncated_svd_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 6))
    df = spark.createDataFrame(
        [(i, Vectors.sparse(6, range(6), row.tolist())) for i, row in enumerate(m)],
        ["doc_id", "features"],
    )
    got = {r["doc_id"]: r["coordinates"] for r in projection.truncated_svd(df, 2).collect()}
    _, s, _ = np.linalg.svd(m)
    coords = np.array([got[i] for i in range(30)])
    assert np.linalg.norm(coords, axis=0) == pytest.approx(s[:2])


def test_narrow_vectors_are_not_read_in_every_iteration(spark, monkeypatch):
    """Sparse and dense rows in one pass over their column products, nothing persisted, all directions like NumPy's."""
    import numpy as np

    def stop(*args, **kwargs):
        raise AssertionError("iterates over the rows")

    monkeypatch.setattr(projection.IndexedRowMatrix, "computeSVD", stop)
    monkeypatch.setattr(projection, "STRIPE", 64)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 150)) * (rng.random((400, 150)) < 0.2) * np.linspace(3, 1, 150)
    m[7] = 0
    vectors = [
        Vectors.dense(row) if i % 5 == 0 else Vectors.sparse(150, np.flatnonzero(row), row[np.flatnonzero(row)])
        for i, row in enumerate(m)
    ]
    df = spark.createDataFrame(list(enumerate(vectors)), ["doc_id", "features"]).repartition(5)
    got = {r["doc_id"]: r["coordinates"] for r in projection.truncated_svd(df, 20).collect()}
    coords = np.array([got[i] for i in range(400)])
    _, s, v = np.linalg.svd(m)
    assert np.linalg.norm(coords, axis=0) == pytest.approx(s[:20])
    assert np.abs(coords) == pytest.approx(np.abs(m @ v[:20].T), abs=1e-8)


def test_preprocess_report_counts_missing_rows(spark):
    data = [(i, f"word{i % 3} claim", i % 2) for i in range(40)]
    data += [(40, None, 1), (41, "x", None), (42, "the of !!!", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    done = preprocess.preprocess(df, maxlen=4, positive_value=0)
    r = done.report.first()
    assert (r["rows_total"], r["rows_used"], r["rows_dropped"]) == (43, 40, 3)
    assert r["vocab_size"] == 6
    assert r["splits"]["train"]["n"] == 28 and r["splits"]["train"]["classes"] == {"0": 14, "1": 14}
    seqs = done.sequences.collect()
    assert len(seqs) == 40 and all(len(s["seq"]) == 4 for s in seqs)
    flipped = {s["doc_id"]: s["label"] for s in seqs}
    assert flipped[0] == 1 and flipped[1] == 0


def test_forests_share_the_cores(spark, monkeypatch):
    """A pass over many partitions costs as many times the statistics of its nodes."""
    rows = spark.range(0, 200, 1, 40).selectExpr(
        "id AS doc_id", "CAST(id % 2 AS INT) AS label", "CAST(id % 5 AS INT) AS fold", "CAST(id % 2 + 1 AS INT) AS step"
    )
    assert classifiers.tree_rows(rows, 20_000, 4096).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert classifiers.tree_rows(rows, 20_000, 4096, fits=8).rdd.getNumPartitions() == 2
    assert classifiers.tree_rows(rows, 20 * 32768, 4096).rdd.getNumPartitions() == 20
    assert classifiers.tree_rows(rows, 200, 4096).rdd.getNumPartitions() == 40  # few rows stay where they are
    assert classifiers.tree_rows(rows, 20_000, 4096).count() == 200

    seen = []

    class Watched(type(classifiers.logistic_regression(80))):
        def _fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))
            return super()._fit(df)

    features = VectorAssembler(inputCols=["doc_id"], outputCol="features").transform(rows)
    curve = tuning.learning_curve(features, Watched(maxIter=2), 5, 2, parallelism=4, width=1 << 20)
    assert curve.count() == 2
    assert {n for n, _ in seen} == {2} and sorted(n for _, n in seen) == [80] * 5 + [160] * 5
