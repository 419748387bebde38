from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textassay import session
from textassay.operators import (
    clusters, curves, errors, joins, metrics, ordered, profiles, setops, splits, tfidf, vocab,
)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def predictions(spark, matrix):
    """Rows (label, prediction) with the counts of a 2 x 2 matrix, built by Spark."""
    (tn, fp), (fn, tp) = matrix
    cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")


# --- splits ---


def two_classes(spark, per_class=100):
    return spark.range(2 * per_class).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label")
    )


def test_stratified_split_shares(spark):
    df = two_classes(spark)
    split = splits.stratified_split(df)
    assert rows(split.groupBy("label", "split").count(), "label", "split", "count") == sorted(
        (label, s, n) for label in (0, 1) for s, n in (("train", 70), ("val", 15), ("test", 15))
    )
    assert rows(split, "doc_id", "split") == rows(splits.stratified_split(df), "doc_id", "split")
    other = splits.stratified_split(df, seed=7)
    assert rows(split, "doc_id", "split") != rows(other, "doc_id", "split")


@pytest.mark.parametrize("chars", [1, 2, 4])
def test_cuts_do_not_depend_on_buckets(spark, chars):
    """One class holds almost all rows; brute-force ranks are the answer."""
    df = spark.range(997).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 990, 0).otherwise(1).alias("label")
    )
    cuts = splits.hash_cuts(df.select("label", "doc_id"), "label", lambda n: [n - n + 3, n - n + 500], bucket_chars=chars)
    numbered = splits.with_cut_number(df, cuts, "label", 2, "no")
    from hashlib import md5

    for label, size in ((0, 990), (1, 7)):
        ids = [i for i in range(997) if (0 if i < 990 else 1) == label]
        ids.sort(key=lambda i: (md5(f"{i}:42".encode()).hexdigest(), i))
        expected = {i: (0 if k < 3 else 1 if k < 500 and size >= 500 else 2) for k, i in enumerate(ids)}
        got = {r["doc_id"]: r["no"] for r in numbered.where(F.col("label") == label).collect()}
        assert got == expected


def test_tiny_strata_keep_all_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    assert splits.stratified_split(df).count() == 3
    assert splits.stratified_split(df.limit(0)).count() == 0


def test_balanced_sample(spark):
    df = spark.range(300).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 40, 1).otherwise(0).alias("label")
    )
    counted = rows(splits.balanced_sample(df).groupBy("label").count(), "label", "count")
    assert counted == [(0, 40), (1, 40)]
    small = rows(splits.balanced_sample(df, 20).groupBy("label").count(), "label", "count")
    assert small == [(0, 10), (1, 10)]


def test_folds_are_nested(spark):
    df = splits.folds(two_classes(spark))
    counts = dict(rows(df.groupBy("step").count(), "step", "count"))
    assert counts == {j: 20 for j in range(1, 11)}
    assert {r["fold"] for r in df.collect()} == {0, 1, 2, 3, 4}


# --- order ---


def test_ordered_index_over_many_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v")).repartition(7)
    got = rows(ordered.ordered_index(df, [F.desc("v")], "at"), "v", "at")
    assert got == [(v, 4999 - v) for v in range(5000)]


def test_running_totals_by_group(spark):
    rng = random.Random(1)
    data = [(g, v, rng.randint(0, 9)) for g in "ab" for v in range(400)]
    df = spark.createDataFrame(data, "g string, v int, n int").repartition(5)
    got = ordered.running_totals(df, [F.desc("v")], ["n"], ["g"])
    for g in "ab":
        mine = sorted((d for d in data if d[0] == g), key=lambda d: -d[1])
        total, run = sum(d[2] for d in mine), 0
        expected = {}
        for _, v, n in mine:
            run += n
            expected[v] = (run, total)
        there = got.where(F.col("g") == g).collect()
        assert {r["v"]: (r["cum_n"], r["total_n"]) for r in there} == expected


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    r = ordered.quantiles(df, "v", {"med": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}).first()
    assert (r["med"], round(r["p90"], 9), r["lo"], r["hi"]) == (5.5, 9.1, 1.0, 10.0)


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = ordered.top_k(df, 3, [F.desc("id")], ["g"])
    assert rows(top, "g", "rank", "id") == [(0, 1, 998), (0, 2, 996), (0, 3, 994),
                                            (1, 1, 999), (1, 2, 997), (1, 3, 995)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


# --- joins, vocabulary, tf-idf ---


def word_rows(spark):
    return spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["b", "zz"]), (3, [])],
                                 "doc_id long, words array<string>")


def test_vocabulary_and_encoding(spark):
    df = word_rows(spark)
    v = vocab.build_vocabulary(df.where("doc_id = 1"))
    assert rows(v, "word", "idx") == [("a", 3), ("b", 2)]
    assert vocab.vocabulary_size(v).first()[0] == 4
    assert rows(vocab.encode(df, v), "doc_id", "seq") == [(1, [2, 3, 2]), (2, [2, 1]), (3, [])]
    padded = vocab.encode_padded(df, v, 2)
    assert rows(padded, "doc_id", "seq") == [(1, [2, 3]), (2, [2, 1]), (3, [0, 0])]


def test_hot_words_are_salted_without_changing_the_result(spark, monkeypatch):
    data = [(i, ["hot"] * 3 + [f"w{i % 7}", f"rare{i}"]) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, words array<string>")
    v = vocab.store_vocabulary(vocab.build_vocabulary(df.where("doc_id < 150")))
    hot = joins.hot_keys(v, "word", "n", limit=10)
    assert {r["word"] for r in hot.collect()} == {"hot"} | {f"w{i}" for i in range(7)}
    plain = rows(vocab.encode(df, v), "doc_id", "seq")
    small = vocab.encode(df, v, hot_limit=10)
    assert "BroadcastHashJoin" in plan_of(small) and rows(small, "doc_id", "seq") == plain
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    salted = vocab.encode(df, v, hot_limit=10)
    assert "SortMergeJoin" in plan_of(salted) and "_salt" in plan_of(salted)
    assert rows(salted, "doc_id", "seq") == plain
    kept = vocab.encode_padded(df.withColumn("split", F.lit("x")), v, 3, keep=["split"])
    assert plan_of(kept).count("Join") == 1 and kept.columns == ["doc_id", "split", "seq"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_measures_travel_and_texts_do_not(spark, monkeypatch, bytes_):
    monkeypatch.setattr(session, "BROADCAST_BYTES", bytes_)
    data = [(i, f"some text {i}") for i in range(20)] + [(90, None)]
    docs = session.materialise(spark.createDataFrame(data, "doc_id long, text string"), "docs")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 30, 2)] + [(1, None), (90, 1)], "doc_id long, quality int")
    labels = session.materialise(labels, "labels")
    found = joins.attach_measure(docs, labels, F.length("text"))
    assert rows(found, "doc_id", "measure", "label") == [(i, len(f"some text {i}"), 0) for i in range(0, 20, 2)]
    sent = [line for line in plan_of(found).splitlines() if "Exchange hashpartitioning" in line]
    assert ("BroadcastHashJoin" in plan_of(found)) == bool(bytes_)
    assert bool(sent) == (not bytes_)
    below = plan_of(found).split("Exchange hashpartitioning")[1:2]
    assert not below or "length(text" in below[0]


def terms_frame(spark):
    return spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["x", "z", "z"])],
                                 "doc_id long, terms array<string>")


@pytest.mark.parametrize("limit", [None, 1])
def test_tfidf(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0 if limit else 1 << 20)
    docs = terms_frame(spark)
    model = tfidf.fit_tfidf(docs, hot_limit=limit)
    assert (model.hot is None) == (limit is None)
    idf = {r["term"]: round(r["idf"], 4) for r in model.vocabulary.collect()}
    assert {t: v for t, v in idf.items() if " " not in t} == {"x": 1.0, "y": 1.6931, "z": 1.6931}
    got = {(r[0], r[1]): r[2] for r in tfidf.transform_tfidf(docs, model).collect()}
    # only the words: the ratio of two weights does not depend on the n-grams
    assert got[(3, "z")] / got[(3, "x")] == pytest.approx(0.9591 / 0.2832, abs=1e-3)
    assert got[(2, "x")] == 1.0
    assert {t for d, t in got if d == 3} == {"x", "z", "x z", "z z", "x z z"}
    for doc in (1, 2, 3):
        assert sum(v * v for (d, _), v in got.items() if d == doc) == pytest.approx(1.0)


def test_idf_counts_documents_without_terms(spark):
    docs = terms_frame(spark).unionByName(
        spark.createDataFrame([(4, [])], "doc_id long, terms array<string>")
    )
    idf = {r["term"]: round(r["idf"], 4) for r in tfidf.document_frequencies(docs).collect()}
    assert idf["x"] == 1.2231


# --- metrics ---

PUBLISHED = [
    ([[18145, 9959], [5221, 25993]], (0.7441, 0.7230, 0.8327, 0.7740)),
    ([[17781, 13434], [2812, 26070]], (0.7297, 0.6599, 0.9026, 0.7624)),
]


@pytest.mark.parametrize("matrix, expected", PUBLISHED)
def test_published_matrices(spark, matrix, expected):
    df = predictions(spark, matrix)
    r = metrics.binary_summary(df).first()
    got = tuple(round(r[c], 4) for c in ("accuracy", "precision", "recall", "f1"))
    assert got == pytest.approx(expected, abs=1e-4)
    cells = rows(metrics.confusion_matrix(df), "label", "prediction", "n")
    assert [c[2] for c in cells] == [*matrix[0], *matrix[1]]
    report = {x["class"]: x for x in metrics.classification_report(df).collect()}
    assert report["1"]["precision"] == r["precision"] and report["1"]["recall"] == r["recall"]
    assert report["accuracy"]["f1"] == r["accuracy"]
    assert report["weighted avg"]["support"] == sum(map(sum, matrix))
    s = errors.error_summary(df).first()
    assert (s["fp"], s["fn"]) == (matrix[0][1], matrix[1][0])


def test_empty_cells_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    assert [r[2] for r in rows(metrics.confusion_matrix(df), "label", "prediction", "n")] == [1, 0, 0, 0]
    r = metrics.binary_summary(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    got = {r[0]: round(r[1], 4) for r in metrics.class_weights(df).collect()}
    assert got == {0: 0.6667, 1: 2.0}
    assert metrics.class_weights(df.where("label = 0")).first()["weight"] == 1.0


def test_rmse(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, prob double")
    assert metrics.rmse(df).first()["rmse"] == 0.5


def test_ranking_quality_known_answer(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, prob double")
    totals = curves.score_totals(df)
    r = curves.ranking_quality(totals).first()
    assert r["auc"] == 0.75 and round(r["average_precision"], 4) == 0.8333
    best = curves.best_threshold(curves.pr_points(totals)).first()
    assert best["threshold"] == 0.35 and round(best["f1"], 4) == 0.8


def test_auc_of_a_constant_is_half(spark):
    df = two_classes(spark).withColumn("prob", F.lit(0.3))
    assert curves.ranking_quality(curves.score_totals(df)).first()["auc"] == 0.5


def test_auc_brute_force_with_ties(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "label int, prob double").repartition(6)
    got = curves.ranking_quality(curves.score_totals(df)).first()["auc"]
    assert got == pytest.approx(expected)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "label int, cluster int")
    assert round(clusters.adjusted_rand(df).first()["ari"], 4) == 0.5714
    same = df.withColumn("cluster", F.lit(0)).withColumn("label", F.lit(0))
    assert clusters.adjusted_rand(same).first()["ari"] == 1.0


# --- profiles ---


def test_lengths(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("length"))
    r = profiles.length_stats(df).first()
    assert (r["count"], r["median"], r["p90"], r["p95"], r["max"]) == (10, 5.5, 9, 9, 10)
    assert profiles.recommended_length(df).first()["recommended_maxlen"] == 32


def test_box_stats(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)], "kind string, symbols int")
    r = profiles.box_stats(df, "kind", ["symbols"]).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (1, 4, 1)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.5), (0, 1.0), (1, 0.7)], "label int, prob double")
    got = rows(profiles.score_histogram(df, 10), "label", "bin", "n")
    assert got == [(0, 0, 1), (0, 5, 1), (0, 9, 1), (1, 5, 1)]


# --- set operations ---

# The default search space of a recurrent network.
NETWORK_SPACE = {
    "embed_dim": [64, 128, 192], "lstm_units": [96, 128, 160], "merge_mode": ["concat", "sum"],
    "dropout": [0.1, 0.2, 0.3], "recurrent_dropout": [0.0, 0.1, 0.2], "lr": [1e-3, 5e-4, 2e-4],
    "batch_size": [64, 96, 128], "epochs": [8, 12, 16], "class_weight": [True],
}


def test_parameter_grid(spark):
    grid = setops.parameter_grid(spark, NETWORK_SPACE)
    assert grid.count() == 4374 == grid.distinct().count()


def test_merge_and_duplicates(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "text string")
    b = spark.createDataFrame([("x",)], "text string")
    merged = setops.merge_labelled(a, b)
    assert rows(setops.drop_exact_duplicates(merged), "text", "label") == [("x", 0), ("x", 1)]
