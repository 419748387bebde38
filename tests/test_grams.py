"""Packed n-grams, and what a write leaves on disk."""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textassay.functions.text import count_repeats, ngrams
from textassay.operators import grams, tfidf
from textassay.session import CLEANUP, materialise

ROWS = [
    (1, ["a", "b", "a"]), (1, ["b"]), (2, None), (3, []), (None, ["x", "y"]), (None, ["x", "éééé long word"]),
    (4, ["x", None, "y"]), (5, ["b", "a b", "c" * 40]), (6, ["never", "seen"]),
]


def grams_of(words):
    words = words or []
    made = [w for w in words if w is not None]
    for n in (2, 3):
        made += [" ".join(w for w in words[i : i + n] if w is not None) for i in range(len(words) - n + 1)]
    return Counter(made)


def test_counts_equal_the_column_functions(spark):
    frame = spark.createDataFrame(ROWS, "doc_id int, terms array<string>")
    counted = frame.select(F.monotonically_increasing_id().alias("i"), "terms", count_repeats(ngrams(F.col("terms"))).alias("e"))
    for r in counted.collect():
        terms, _, code, times = grams.count_grams(pa.array([r["terms"]], pa.list_(pa.string())))
        got = {terms[int(c)].as_py(): int(n) for c, n in zip(code, times)}
        assert got == dict(grams_of(r["terms"]))
        if None not in (r["terms"] or []):
            assert got == {e["term"]: e["tf"] for e in r["e"] or []}


def test_terms_are_packed_and_dealt():
    terms = pa.array(["a", "", "éè", "word", "eight888", "a longer n-gram here"])
    for some in (terms, terms.slice(2, 3), terms.slice(0, 0)):
        cell = pa.scalar(grams.pack_terms(some), pa.binary())
        assert grams.unpack_terms(cell).to_pylist() == some.to_pylist()
    alone = [int(grams.part_of(pa.array([t]), 7)[0]) for t in terms.to_pylist()]
    assert grams.part_of(terms, 7).tolist() == alone and grams.part_of(terms.slice(2), 7).tolist() == alone[2:]


@pytest.mark.parametrize("words", [1, 1 << 17])
def test_blocks_and_parts_change_no_row(spark, monkeypatch, words):
    """Repeated and null keys, null words, blanks in words: one document per key, whatever the blocks."""
    monkeypatch.setattr(grams, "BLOCK_WORDS", words)
    monkeypatch.setattr(grams, "PART_TERMS", 2 if words == 1 else 1 << 22)
    docs = materialise(spark.createDataFrame(ROWS, "doc_id int, terms array<string>").withColumn("side", F.lit("s")), "docs")
    model = tfidf.fit_tfidf(docs.where("doc_id is null or doc_id < 6"))
    fitted = [grams_of(t) for k, t in ROWS if k is None or k < 6]
    df = Counter(t for c in fitted for t in c)
    idf = {t: math.log((1 + len(fitted)) / (1 + n)) + 1 for t, n in df.items()}
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == df
    squares = Counter()
    for k, t in ROWS:
        squares[k] += sum((n * idf[g]) ** 2 for g, n in grams_of(t).items() if g in idf)
    want = sorted((str(k), "s", g, round(n * idf[g] / squares[k] ** 0.5, 9)) for k, t in ROWS for g, n in grams_of(t).items() if g in idf)
    found = tfidf.transform_tfidf(docs, model, keep=("side",))
    assert found.columns == ["doc_id", "side", "term", "tfidf"]
    assert sorted((str(k), s, g, round(v, 9)) for k, s, g, v in found.collect()) == want
    norms = {r["doc_id"]: r["norm"] for r in tfidf.document_norms(docs, model).collect()}
    assert norms == pytest.approx({k: v**0.5 for k, v in squares.items() if v})


def test_terms_are_no_rows_of_a_shuffle(spark, tmp_path):
    """Far fewer rows are shuffled than documents have terms."""
    docs = [(i, [f"w{(i * 7 + k) % 300}" for k in range(200)]) for i in range(200)]
    docs = materialise(spark.createDataFrame(docs, "doc_id int, terms array<string>"), "docs")
    found = tfidf.transform_tfidf(docs, tfidf.fit_tfidf(docs))
    found.write.parquet(f"{tmp_path}/found")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "term#" not in plan.split("Exchange", 1)[1].split("MapInArrow", 1)[0]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """The write's own shuffle goes with it; the session's setting is as before."""
    name = uuid.uuid4().hex
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(1 for b in range(local.getAllFiles().size()) if "shuffle" in str(local.getAllFiles().apply(b)))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    stored = materialise(spark.range(20_000).select((F.col("id") % 7_000).alias("k")).groupBy("k").count(), name)
    for _ in range(50):
        if files() <= before:
            break
        os.sched_yield()
        spark.sparkContext._jvm.java.lang.Thread.sleep(100)
    assert files() <= before and stored.count() == 7_000
    assert spark.conf.get(CLEANUP, None) == setting
