"""Block matrices, regression, SVD, term selection, language models and silhouette against independent solvers."""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textassay.operators import blocks, clusters, selection, tfidf
from textassay.plans import regression, sequence, svd
from textassay.plans.features import selected_vectors
from textassay.session import discard, materialise, scratch_path


@pytest.fixture(scope="module")
def dense():
    """Rows of unit length, some empty, one much longer than the others."""
    draw = np.random.default_rng(0)
    x = np.zeros((120, 700))
    for i in range(len(x)):
        k = 400 if i == 7 else int(draw.integers(0, 25))
        x[i, draw.choice(700, k, replace=False)] = draw.random(k)
    x[:, 3] += draw.random(120)  # a direction that stands out
    x[11] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    y = (x @ draw.normal(size=700) * 5 + 0.3 > 0).astype(int)
    return x, y


@pytest.fixture(scope="module")
def entries(spark, dense):
    x, _ = dense
    rows = [(i, f"t{j:04d}", float(x[i, j])) for i in range(len(x)) for j in np.flatnonzero(x[i])]
    return materialise(spark.createDataFrame(rows, "doc_id bigint, term string, tfidf double"), "entries")


@pytest.fixture(scope="module")
def keys(spark, dense):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(dense[1])], "doc_id bigint, label int")


def test_products_of_blocks(spark, dense, entries, keys):
    x, _ = dense
    matrix = blocks.block_matrix(entries, keys, width=100, block_entries=300)
    assert matrix.pieces.select("i").distinct().count() > 3 and matrix.pieces.select("j").distinct().count() == 7
    term = {r["col"]: int(r["term"][1:]) for r in matrix.columns.collect()}
    factor = np.random.default_rng(1).normal(size=(700, 3))
    wide = np.zeros((700, 3))
    for col, j in term.items():
        wide[col] = factor[j]
    stored = [(b, wide[100 * b : 100 * b + 100].tobytes()) for b in range(7)]
    product = blocks.times(matrix, spark.createDataFrame(stored, blocks.FACTOR), 3)
    place = {(r["i"], r["r"]): r["doc_id"] for r in matrix.rows.collect()}
    for r in product.collect():
        for n, line in enumerate(np.frombuffer(r["m"]).reshape(-1, 3)):
            assert np.allclose(line, x[place[r["b"], n]] @ factor)


def newton(x, y, c=1.0):
    w, wide = np.zeros(x.shape[1] + 1), np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0 / c] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-wide @ w))
        w -= np.linalg.solve((wide.T * (p * (1 - p))) @ wide + penalty, wide.T @ (p - y) + penalty @ w)
    return w


def test_regression_equals_newton(spark, dense, entries, keys):
    x, y = dense
    matrix = blocks.block_matrix(entries, keys, width=256, block_entries=400)
    model = regression.fit_term_regression(matrix, tol=1e-6)
    expected = newton(x, y)
    for r in model.coefficients.collect():
        assert abs(r["weight"] - expected[int(r["term"][1:])]) < 1e-4
    assert abs(model.intercept - expected[-1]) < 1e-4
    objectives = [h[1] for h in model.history]
    assert objectives == sorted(objectives, reverse=True) and model.history[-1][2] < 1e-4
    path = scratch_path(spark, "regression")
    assert regression.load_regression(spark, path) is None
    regression.save_regression(model, path)
    again = regression.load_regression(spark, path)
    assert again.history == model.history and again.intercept == model.intercept
    scored = regression.score_terms(entries, keys, again).collect()
    margins = x @ expected[:-1] + expected[-1]
    assert len(scored) == len(x)
    assert all(abs(r["prob"] - 1 / (1 + math.exp(-margins[r["doc_id"]]))) < 1e-4 for r in scored)


def test_svd_equals_numpy(spark, dense, entries, keys):
    x, _ = dense
    u, values, _ = np.linalg.svd(x, full_matrices=False)
    whole = svd.term_svd(entries, keys, k=150, width=256, block_entries=400)
    rank = int((values > 1e-9).sum())
    assert np.allclose(whole.values[:rank], values[:rank], rtol=1e-6)
    c = np.zeros((len(x), len(whole.values)))
    for r in whole.coordinates.collect():
        c[r["doc_id"]] = r["coordinates"]
    assert np.allclose(c @ c.T, x @ x.T, atol=1e-8)
    first = u[:, 0] * values[0] * np.sign(u[:, 0].sum())
    assert np.allclose(c[:, 0], first, atol=1e-6)
    nothing = svd.term_svd(entries.limit(0), keys.limit(0), k=3)
    assert nothing.values == [] and nothing.coordinates.count() == 0


def test_truncated_svd_of_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    terms = materialise(tfidf.document_terms(docs), "terms")
    rows = materialise(tfidf.transform_tfidf(terms, tfidf.fit_tfidf(terms)), "rows")
    found = svd.term_svd(rows, terms.select("doc_id"), k=10)
    held = rows.collect()
    names = {t: i for i, t in enumerate(sorted({r["term"] for r in held}))}
    order = {d: i for i, d in enumerate(sorted({r["doc_id"] for r in held}))}
    columns = [[] for _ in order]
    for r in held:
        columns[order[r["doc_id"]]].append((names[r["term"]], r["tfidf"]))
    x = np.zeros((len(order), len(names)), np.float32)
    for i, part in enumerate(columns):
        for j, v in part:
            x[i, j] = v
    gram = x.astype(np.float64) @ x.T.astype(np.float64)
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1][:10], 0))
    assert np.allclose(found.values, values, rtol=0.01)


def test_chi_squared(spark):
    rows = [(1, ["a", "b"], 0), (2, ["a"], 1), (3, ["c", "a"], 1), (4, [], 2), (5, ["b", "b"], 0), (6, ["z"], None)]
    docs = spark.createDataFrame(rows, "doc_id int, terms array<string>, label int")
    found = {r["term"]: (r["df"], r["chi2"]) for r in selection.chi_squared(docs).collect()}
    sets = [(set(t) | {" ".join(p) for p in zip(t, t[1:])}, y) for _, t, y in rows if y is not None]
    for term, (df, chi2) in found.items():
        expected = 0.0
        for c in (0, 1, 2):
            n = sum(y == c for _, y in sets)
            for present in (True, False):
                o = sum((term in s) == present and y == c for s, y in sets)
                e = n * (df if present else len(sets) - df) / len(sets)
                expected += (o - e) ** 2 / e if e else 0.0
        assert df == sum(term in s for s, _ in sets) and abs(chi2 - expected) < 1e-12
    assert "z" not in found and set(found) == {"a", "b", "c", "a b", "c a", "b b"}
    assert [r["term"] for r in selection.select_terms(selection.chi_squared(docs), 2).collect()][0] == "b"
    assert selection.chi_squared(docs.limit(0)).count() == 0


def test_selected_vectors_are_scaled_by_whole_documents(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a"]), (3, [])]
    docs = spark.createDataFrame(rows, "doc_id int, terms array<string>")
    model = tfidf.fit_tfidf(docs)
    whole = {(r["doc_id"], r["term"]): r["tfidf"] for r in tfidf.transform_tfidf(docs, model).collect()}
    chosen = spark.createDataFrame([("a",), ("c",), ("unknown",)], "term string")
    names, found = selected_vectors(docs, model, chosen, ["doc_id"])
    assert names == ["a", "c"]
    for r in found.collect():
        for name, value in zip(names, r["features"].toArray()):
            assert abs(value - whole.get((r["doc_id"], name), 0.0)) < 1e-12


def test_saved_vectoriser(spark):
    docs = spark.createDataFrame([(i, ["common", f"w{i % 9}"]) for i in range(60)], "doc_id int, terms array<string>")
    model = tfidf.fit_tfidf(docs, hot_limit=20)
    assert model.hot is not None
    path = scratch_path(spark, "vectoriser")
    tfidf.save_tfidf(model, path, buckets=3)
    other = spark.newSession()
    again = tfidf.load_tfidf(other, path)
    new = other.createDataFrame([(1, ["common", "w1", "never seen"]), (2, [])], "doc_id int, terms array<string>")
    rows = lambda m, d: sorted((r[0], r[1], round(r[2], 12)) for r in tfidf.transform_tfidf(d, m).collect())
    assert rows(again, other.createDataFrame(docs.collect(), docs.schema)) == rows(model, docs)
    assert {r[1] for r in rows(again, new)} == {"common", "w1", "common w1"}
    left = other.createDataFrame([("w1", 1)], "term string, n int").hint("shuffle_merge")
    plan = left.join(again.vocabulary.hint("merge"), "term")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the vocabulary stays where it is
    with pytest.raises(Exception):
        tfidf.load_tfidf(spark, scratch_path(spark, "nothing"))


def test_pair_model_equals_brute_force(spark):
    texts = ["a b c", "a b d", "b c", "a", "", "c c c a b", "d d", "e a b"]
    labels = [0, 1, 0, 1, 0, 0, 1, 1]
    rows = [(i, t.split(), y) for i, (t, y) in enumerate(zip(texts, labels))]
    table = spark.createDataFrame(rows, "doc_id int, words array<string>, label int")
    model = sequence.fit_pair_model(table)
    test = spark.createDataFrame([(1, "a b zz c".split()), (2, []), (3, None), (4, ["zz"] * 3)], "doc_id int, words array<string>")
    found = {r["doc_id"]: r for r in sequence.score_pairs(test, model, []).collect()}
    pairs = lambda ws: list(zip([" ", *ws], [*ws, " "]))
    counts = {c: Counter(p for _, w, y in rows if y == c for p in pairs(w)) for c in (0, 1)}
    words = len({w for c in (0, 1) for _, w in counts[c]}) + 1

    def discount(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return once / (once + 2 * twice) if once else 0.5

    def log_chance(c, v, w):
        k = Counter(b for _, b in counts[c])
        d, e = discount(counts[c].values()), discount(k.values())
        s = sum(k.values())
        low = max(k[w] - e, 0) / s + e * len(k) / s / words
        n = sum(x for (a, _), x in counts[c].items() if a == v)
        t = sum(a == v for a, _ in counts[c])
        return math.log((max(counts[c][v, w] - d, 0) + d * t * low) / n if n else low)

    for key, ws in ((1, "a b zz c".split()), (2, []), (3, []), (4, ["zz"] * 3)):
        llr = sum(log_chance(1, *p) - log_chance(0, *p) for p in pairs(ws))
        assert abs(found[key]["llr"] - llr) < 1e-9 and found[key]["n_pairs"] == len(ws) + 1
    # what follows a word adds up to one
    for c in (0, 1):
        known = {w for x in (0, 1) for _, w in counts[x]}
        assert abs(sum(math.exp(log_chance(c, "a", w)) for w in known | {"unknown"}) - 1) < 1e-9


def test_euclidean_silhouette(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 10)
    draw = np.random.default_rng(2)
    rows = [(i, i % 3, (draw.normal(size=4) + i % 3).tolist()) for i in range(70)] + [(99, 7, [9.0] * 4)]
    rows += [(98, 0, rows[0][2]), (97, None, rows[0][2]), (96, 1, None)]
    table = spark.createDataFrame(rows, "k int, c int, v array<double>")
    kept = [(c, np.array(v)) for _, c, v in rows if c is not None and v is not None]
    values = []
    for i, (c, v) in enumerate(kept):
        far = {}
        for j, (d, u) in enumerate(kept):
            if i != j:
                far.setdefault(d, []).append(np.linalg.norm(v - u))
        if c not in far:
            values.append(0.0)
            continue
        a, b = np.mean(far[c]), min(np.mean(x) for d, x in far.items() if d != c)
        values.append((b - a) / max(a, b))
    found = clusters.euclidean_silhouette(table, "k", "c", "v", rows=None).first()
    assert found["n"] == len(kept) and abs(found["silhouette"] - np.mean(values)) < 1e-6
    assert clusters.euclidean_silhouette(table, "k", "c", "v", rows=20).first()["n"] == 20
    one = clusters.euclidean_silhouette(table.where(F.col("c") == 0), "k", "c", "v").first()
    assert one["silhouette"] is None


def test_words_of_a_pair_are_not_shuffled_beside_it(spark, monkeypatch):
    """The join on pairs gets the pair alone; the words are cut out behind it, and scores need no table to be small."""
    rows = [(i, ["a", "b", "cc", "a"][: i % 5] + ["d"] * (i % 3), i % 2) for i in range(20)]
    rows = spark.createDataFrame(rows, "doc_id long, words array<string>, label int")
    model = sequence.fit_pair_model(rows)
    want = {r["doc_id"]: r["llr"] for r in sequence.score_pairs(rows, model, []).collect()}
    join, seen = sequence.lookup_join, {}

    def watch(each, table, name, *rest):
        seen[name] = set(each.columns)
        return join(each, table, name, *rest)

    monkeypatch.setattr(sequence, "lookup_join", watch)
    monkeypatch.setattr("textassay.session.BROADCAST_BYTES", 1)
    got = {r["doc_id"]: r["llr"] for r in sequence.score_pairs(rows, model, []).collect()}
    assert got == pytest.approx(want) and len(got) == 20
    assert seen["pair"] == {"doc_id", "pair", "n"} and "pair" not in seen["v"] | seen["w"]


def test_silhouette_sends_a_vector_once_for_each_chunk(spark, monkeypatch):
    """Chunks of several blocks with cut clusters and equal vectors; what is joined does not go by blocks."""
    draw = np.random.default_rng(8)
    points = np.round(draw.normal(size=(230, 3)), 1)
    labels = draw.integers(0, 4, 230)
    table = spark.createDataFrame([(i, f"c{c}", v.tolist()) for i, (c, v) in enumerate(zip(labels, points))], "k int, c string, v array<float>")
    far = np.linalg.norm(points.astype("float32").astype(float)[:, None] - points.astype("float32"), axis=2)
    sums = np.array([[far[i][labels == c].sum() for c in range(4)] for i in range(230)])
    sizes = np.bincount(labels)
    a = sums[np.arange(230), labels] / (sizes[labels] - 1)
    means = sums / sizes
    means[np.arange(230), labels] = np.inf
    want = np.mean((means.min(axis=1) - a) / np.maximum(a, means.min(axis=1)))
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 7)
    monkeypatch.setattr(clusters, "CHUNK_ROWS", 100)
    stored, written = clusters.materialise, {}

    def count(df, name):
        written[name] = stored(df, name)
        return written[name]

    monkeypatch.setattr(clusters, "materialise", count)
    found = clusters.euclidean_silhouette(table, "k", "c", "v", rows=None).first()
    assert found["n"] == 230 and abs(found["silhouette"] - want) < 1e-6
    assert written["vector_chunks"].count() <= 2 * spark.sparkContext.defaultParallelism


def test_gram_product_of_groups_and_parts(spark, dense, entries, keys):
    x, _ = dense
    matrix = blocks.block_matrix(entries, keys, width=100, block_entries=300)
    place = {(r["i"], r["r"]): r["doc_id"] for r in matrix.rows.collect()}
    sizes = Counter(i for i, _ in place)
    factor = np.random.default_rng(1).normal(size=(len(x), 5))
    stored = [(i, np.array([factor[place[i, r]] for r in range(n)]).tobytes()) for i, n in sizes.items()]
    stored = spark.createDataFrame(stored, blocks.FACTOR)
    for groups, parts in ((None, None), (2, 3), (5, 1)):
        made = blocks.gram_times(matrix, stored, 5, groups, parts).collect()
        assert sorted(r["b"] for r in made) == sorted(sizes)
        for r in made:
            for n, line in enumerate(np.frombuffer(r["m"]).reshape(-1, 5)):
                assert np.allclose(line, x[place[r["b"], n]] @ (x.T @ factor))


def test_a_range_of_columns_is_cut_by_its_entries(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RANGE_ENTRIES", 100)
    rows = [(i, f"t{j}", 1.0) for i in range(50) for j in range(12)]
    dense_rows = materialise(spark.createDataFrame(rows, "doc_id int, term string, tfidf double"), "few_terms")
    matrix = blocks.block_matrix(dense_rows, dense_rows.select("doc_id").distinct())
    assert matrix.width == 2 and matrix.pieces.select("j").distinct().count() == 6


def test_regression_forms_no_term_vector_before_the_end(dense, entries, keys, monkeypatch):
    x, y = dense
    sizes = []

    def ended(matrix, factor, columns=1):
        sizes.append(columns)
        return blocks.transposed_times(matrix, factor, columns)

    monkeypatch.setattr(regression, "transposed_times", ended)
    matrix = blocks.block_matrix(entries, keys, width=256, block_entries=400)
    model = regression.fit_term_regression(matrix, tol=1e-3)
    assert sizes == [1] and len(model.history) > 3
    assert model.history[-1][2] <= 1e-3 * model.history[0][2]
    empty = regression.fit_term_regression(blocks.block_matrix(entries.limit(0), keys), max_iter=20)
    assert empty.coefficients.count() == 0 and abs(1 / (1 + math.exp(-empty.intercept)) - y.mean()) < 1e-6


def test_matrix_of_odd_keys(spark, monkeypatch):
    """Repeated, null and unknown keys in small chunks and many parts; terms of one entry left out; no table in between stays."""
    monkeypatch.setattr(blocks, "DEALT_ROWS", 7)
    monkeypatch.setattr(blocks, "PART_ENTRIES", 5)
    rows = [(k, f"t{j}", 1.0 + j + (k or 0) / 8) for k in (0, 1, 1, 2, None, 9) for j in range(6) if (k or 0) <= j] + [(2, "once", 3.0)]
    table = materialise(spark.createDataFrame(rows, "doc_id int, term string, tfidf double"), "odd")
    keys = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (None,)], "doc_id int")
    made = []
    monkeypatch.setattr(blocks, "discard", lambda stored: (made.extend(stored.inputFiles()), discard(stored)))
    matrix = blocks.block_matrix(table, keys, least=2, width=2, block_entries=600)
    df = Counter(t for _, t, _ in rows)
    columns = {r["col"]: (r["term"], r["df"]) for r in matrix.columns.collect()}
    assert sorted(columns) == list(range(6)) and dict(columns.values()) == {t: n for t, n in df.items() if n > 1}
    place = {(r["i"], r["r"]): r["doc_id"] for r in matrix.rows.collect()}
    assert len(place) == 6
    found = Counter()
    for p in matrix.pieces.collect():
        assert p["n"] == sum(i == p["i"] for i, _ in place)
        found.update((place[p["i"], r], columns[p["j"] * 2 + c][0], v) for r, c, v in zip(p["r"], p["c"], p["v"]))
    copies = Counter(k for k, in [(0,), (1,), (1,), (2,), (3,)])
    assert found == Counter({(k, t, v): n * copies[k] for (k, t, v), n in Counter(rows).items() if copies[k] and df[t] > 1})
    assert made and not any(os.path.exists(name.removeprefix("file:").replace("///", "/")) for name in made)


def test_spent_entries_are_removed(spark, dense, keys):
    x, _ = dense
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(40) for j in np.flatnonzero(x[i])]
    stored = materialise(spark.createDataFrame(rows, "doc_id bigint, term string, tfidf double"), "spent")
    files = [name.removeprefix("file:").replace("///", "/") for name in stored.inputFiles()]
    assert all(map(os.path.exists, files))
    found = svd.term_svd(stored, keys.where("doc_id < 40"), k=3, spent=True)
    assert found.coordinates.count() == 40 and not any(map(os.path.exists, files))
    assert np.allclose(found.values, np.linalg.svd(x[:40], compute_uv=False)[:3], rtol=1e-3)
