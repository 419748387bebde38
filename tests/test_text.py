from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textassay.functions import text as tx


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(fn(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (
            tx.clean_text,
            "<p>Vaccines DON'T work!</p> It's well-known: 95% of people.",
            "vaccines work well-known 95 people",
        ),
        (tx.clean_text, "this is not true", "not true"),
        (tx.clean_text, "the of !!!", ""),
        (tx.clean_text, None, ""),
        (tx.strip_tags, "end.<br>Start a.b", "end.Start a.b"),
        (tx.strip_tags, "a <b\nc> d", "a <b\nc> d"),
        (lambda c: tx.strip_punctuation(tx.strip_tags(c)), "end.<br>Start a.b", "endStart ab"),
        (tx.strip_punctuation, "café ½", "café ½"),
        (tx.words, "cat bee", ["cat", "bee"]),
        (tx.lower_strip, "  Ab C\t", "ab c"),
        (tx.terms, "A cat, the B52 x", ["cat", "b52"]),
        (tx.sequence_words, "well-known don't_x", ["well", "known", "don't", "x"]),
        (tx.caps_count, "NASA and A USA x", 2),
        (tx.symbol_count, "what?! 100%", 3),
    ],
)
def test_text_function(spark, fn, given, expected):
    assert one(spark, given, fn) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("cafÃ©", "café"),
        ("“quoted”", '"quoted"'),
        ("it’s", "it's"),
        ("ﬁne", "fine"),
        ("é", "é"),
        ("a &amp; b", "a & b"),
        ("a <b> &amp; b", "a <b> &amp; b"),
        ("x\r\ny z", "x\ny\nz"),
        ("a\x00b﻿", "ab"),
        ("plain", "plain"),
        ("Straße naïve", "Straße naïve"),
        ("cafÃ©\ncafé", "café\ncafé"),
        (None, None),
    ],
)
def test_repair(spark, given, expected):
    assert one(spark, given, tx.repair_text) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        (["a1", "b1", "c1"], ["a1", "b1", "c1", "a1 b1", "b1 c1", "a1 b1 c1"]),
        (["a1"], ["a1"]),
        ([], []),
    ],
)
def test_ngrams(spark, given, expected):
    df = spark.createDataFrame([(given,)], "w array<string>")
    assert df.select(tx.ngrams(F.col("w")).alias("r")).first()["r"] == expected


@pytest.mark.parametrize(
    "given, expected", [([5, 6], [5, 6, 0, 0]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4]), ([], [0] * 4)]
)
def test_pad(spark, given, expected):
    df = spark.createDataFrame([(given,)], "s array<int>")
    assert df.select(tx.pad_sequence(F.col("s"), 4).alias("r")).first()["r"] == expected


def test_repair_runs_python_only_where_needed(spark):
    df = spark.createDataFrame([("plain",)], "s string").select(tx.repair_text(F.col("s")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "given, expected",
    [
        (["b", "a", "b", "b"], [("a", 1), ("b", 3)]),
        (["a"], [("a", 1)]),
        ([], []),
        (["x", "x"], [("x", 2)]),
    ],
)
def test_count_repeats(spark, given, expected):
    df = spark.createDataFrame([(given,)], "w array<string>")
    got = df.select(tx.count_repeats(F.col("w")).alias("r")).first()["r"]
    assert [tuple(r) for r in got] == expected


def test_mojibake_is_undone_without_python(spark):
    healthy = ["café naïve", "Größe\nÀ la carte", "日本語 Ω", "Ã© alone stays if it is é", "a\u0301 b", "plain", "", None,
               "Ångström and Å", "x\n\ny é"]
    rows, expected = [], []
    for i, t in enumerate(healthy):
        rows.append((i, t))
        expected.append(t)
        for rounds, table in ((1, "cp1252"), (2, "cp1252"), (1, "latin-1"), (3, "latin-1")):
            broken = t
            try:
                for _ in range(rounds if t else 0):
                    broken = broken.encode().decode(table)
            except UnicodeError:
                continue
            rows.append((100 * len(rows), broken))
            expected.append(t)
    df = spark.createDataFrame(rows, "k int, t string")
    import unicodedata

    import textassay.functions.text as module

    found = [r[0] for r in df.select(module.repair_text(F.col("t"))).collect()]
    undone = lambda t: t if t is None else unicodedata.normalize("NFC", "\n".join(map(latin_again, t.split("\n"))))
    assert found == [undone(t) for _, t in rows]
    assert sum(f == (e and unicodedata.normalize("NFC", e)) for f, e in zip(found, expected)) > 0.8 * len(rows)


def latin_again(line):
    """Brute force of undoing: back to bytes by cp1252 or Latin-1, character by character."""
    for _ in range(4):
        try:
            data = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in line)
            again = data.decode("utf-8")
        except UnicodeError:
            return line
        line = again
    return line


def test_composition_is_looked_for_behind_one_range(spark):
    """The long class is not tried on characters below U+0300, none of which composition changes."""
    found = tx._not_composed()
    assert found.startswith(r"(?=[\x{300}-\x{10ffff}])")
    texts = ["plain", "caf\u00e9 \u02ff", "\u2019s", "e\u0301", "\u0300", "\u212b", "\u1160", "\U0001d15e", "\uac00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(F.col("t").rlike(found)).collect()]
    assert got == [False, False, False, True, True, True, True, True, False]
