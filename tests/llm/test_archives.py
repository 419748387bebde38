"""Hard negatives, spelling variants and WARC archives against brute force, and on odd input."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from textassay.llm import negatives, spelling, warc  # noqa: E402
from textassay.llm.queries import ORACLES, QUERIES  # noqa: E402
from textassay.session import scratch_path  # noqa: E402


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants", "op13_warc_archive"])
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    rows = Counter(map(tuple, QUERIES[name](spark, sf_dir).select(*columns).collect()))
    assert rows == Counter(theirs.fetchall()) and rows


# --- hard negatives ---


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert_keys(cells, bits)
        order = np.lexsort(keys.T[::-1])
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
        assert len({k.tobytes() for k in keys}) == len(cells)


def test_products_stay_exact():
    left, right = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5]])
    assert negatives.products(left, right)[0, 0] == (1 << 60) + 15
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert negatives.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).shape == (2, 3)


def brute_negatives(rows):
    """All windows of all anchors; ``rows`` are (key, label, vector) that take part."""
    out = Counter()
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, (key, label, vector) in enumerate(rows):
        if key is None or key % 50:
            continue
        others = [
            (sum(x * y for x, y in zip(vector, v)), k, l)
            for b, (k, l, v) in enumerate(rows) if b != a and len(v) == len(vector)
        ]
        for score, positive, _ in sorted((r for r in others if r[2] == label), key=order)[:5]:
            window = [r for r in others if r[2] != label and 50 * score <= 100 * r[0] <= 95 * score]
            for rank, (s, k, _) in enumerate(sorted(window, key=order)[:3], 1):
                out[key, positive, rank, k, score, s] += 1
    return out


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)  # many blocks, chunks and pages
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 4)
    monkeypatch.setattr(negatives, "PAGE_BLOCKS", 3)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(400):
        vector = (centres[i % 6] + 0.3 * draw.normal(size=8)).tolist()
        rows.append((i * 10 if i % 3 else i * 50, int(draw.integers(0, 3)), vector))
    rows += [(50, 1, rows[3][2])] * 3 + [(7, 2, rows[3][2])] * 60  # ties, repeats, copies
    rows += [(100, None, rows[0][2]), (150, 1, None), (200, 1, [1.0, None]), (250, 1, [float("nan")] * 8),
             (300, 1, [float("inf")] * 8), (None, 1, rows[0][2]), (350, 1, []), (400, 2, []), (450, 1, [0.0] * 8),
             (500, 0, [1.0, 2.0]), (501, 0, [2.0, 1.0]), (502, 1, [1.0, 1.0])]
    schema = "vec_id bigint, label int, embedding array<double>, chunk string, size string"
    table = spark.createDataFrame([(*r[:2], r[2], "x", "y") for r in rows], schema)
    usable = [
        (k, l, [int(np.floor(256 * x)) for x in v])
        for k, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = negatives.hard_negatives(table)
    assert Counter(map(tuple, found.collect())) == brute_negatives(usable)
    assert negatives.hard_negatives(table.limit(0)).count() == 0


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 32)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 8)) * 4
    rows = [(i, i % 40, (centres[i % 40] + 0.05 * draw.normal(size=8)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    read = []
    score = negatives._score
    monkeypatch.setattr(negatives, "_score", lambda pairs, *rest: read.append(pairs.count()) or score(pairs, *rest))
    negatives.hard_negatives(table).count()
    blocks, chunks = -(-2000 // 32), 1
    assert read[1] < blocks * chunks / 2 or read[1] < blocks * 2


# --- spelling variants ---


def brute_near(words):
    near = defaultdict(set)
    by_cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_cut[i, w[:i] + w[i + 1 :], len(w)].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in by_cut.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(words):
    near, forms = brute_near(words), {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None)
    return out


@pytest.mark.parametrize("shard", [7, 64, 16_384])
def test_spelling_variants(spark, shard):
    draw = np.random.default_rng(11)
    letters = list("abé")
    words = {"".join(draw.choice(letters, draw.integers(6, 9))): int(n) for n in draw.integers(5, 4000, 300)}
    words |= {"aaaaaa": 5, "aaaaaaa": 50, "aaaaaaaa": 400, "x" * 500: 9, "x" * 501: 60, "zebras": 7, "zebra\U0001f642": 99}
    rows = [(w, n, "clash", 1) for w, n in words.items()] + [("short", 9, "", 0), (None, 9, "", 0)]
    table = spark.createDataFrame(rows, "word string, n bigint, best string, shard int")
    found = spelling.spelling_variants(table, shard_words=shard)
    assert {r["word"]: tuple(r)[1:] for r in found.collect()} == brute_variants(words)
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_vocabulary_counts_and_damage(spark):
    rows = [(1, "Résumé ÀBCDEF abcdef, abcdef"), (2, None), (3, ""), (None, "abcdef" * 600), (1, "ABCDEF àbcdef")]
    found = spelling.vocabulary(spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, n int"), min_count=1)
    got = dict(map(tuple, found.collect()))
    expected = Counter()
    import re
    import zlib

    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(run) >= 6:
                expected[run] += 1
    assert got == expected


# --- archives ---


ODD_PAGES = [
    (3, "http://a/1", "same"), (1, "http://b/2", "same"), (None, "http://c", "same"), (1, "http://b/2", "same"),
    (4, None, None), (5, "http://d\r\nWARC-Type: x", ""), (6, "e", "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (7, "f", "é\U0001f642\x00" + "y" * 300_000), (8, "g", "tiny"), (9, "h", "tiny"),
]


def archived(spark, rows=ODD_PAGES, **kwargs):
    schema = "page_id bigint, url string, html string, digest string, payload string"
    return warc.archive(spark.createDataFrame([(*r, "x", "y") for r in rows], schema), **kwargs)


def test_archive_round_trip(spark):
    stored = archived(spark)
    assert stored.payloads.count() == len({r[2] or "" for r in ODD_PAGES})
    path = scratch_path(spark, "warc")
    warc.write_warc(stored, path)
    read = warc.read_warc(spark, path)
    ours = {r["record_id"]: r for r in stored.records.collect()}
    theirs = {r["record_id"]: r for r in read.collect()}
    assert len(theirs) == len(ODD_PAGES) and ours.keys() == theirs.keys()
    for key, r in theirs.items():
        assert bytes(r["header"]).decode() == ours[key]["header"] and r["page_id"] == ours[key]["page_id"]
    pages = Counter((p, (h or "").encode()) for p, _, h in ODD_PAGES)
    whole = warc.reconstruct(stored, revisits=True).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in whole) == pages
    rows = Counter(map(tuple, warc.resolve(read).collect()))
    sha1 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    same = (4, sha1("same"))
    assert rows[1, *same, "response", None] == 1 and rows[1, *same, "revisit", 1] == 1
    assert rows[3, *same, "revisit", 1] == 1 and rows[None, *same, "revisit", 1] == 1
    assert rows[4, 0, sha1(""), "response", None] == 1 and rows[5, 0, sha1(""), "revisit", 4] == 1
    assert rows[9, 4, sha1("tiny"), "revisit", 8] == 1


def test_small_payloads_and_empty_table(spark):
    kinds = {(r["page_id"], r["record_type"]) for r in archived(spark, min_bytes=5).records.collect()}
    assert kinds == {(r[0], "response") for r in ODD_PAGES}
    empty = archived(spark, ODD_PAGES[:1])
    nothing = warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string"))
    path = scratch_path(spark, "warc")
    warc.write_warc(nothing, path)
    assert warc.resolve(warc.read_warc(spark, path)).count() == 0 and empty.records.count() == 1


def test_damage_is_noticed(spark):
    stored = archived(spark)
    from pyspark.sql import functions as F

    broken = warc.Archive(stored.records, stored.payloads.withColumn("payload", F.lit(b"other")))
    with pytest.raises(Exception, match="damaged"):
        warc.reconstruct(broken).collect()


def test_records_follow_the_format():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block)
    data = gzip.compress(record + block + b"\r\n\r\n") + gzip.compress(record + block + b"\r\n\r\n")
    found = list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(data))))
    assert [p for _, _, p in found] == [b"body"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(record + block[:5])))
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"something else\r\n\r\n")))
