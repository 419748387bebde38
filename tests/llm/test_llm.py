"""Each operator against brute force, and on nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from textassay.llm import (  # noqa: E402
    boilerplate, bpe, chat, chunks, fingerprint, language, packing, pii, simhash, vectors,
)
from textassay.llm.components import connected_components  # noqa: E402
from textassay.llm.queries import ORACLES, QUERIES  # noqa: E402

ODD = [
    (1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "x" * 3000), (6, "same words here again now"),
    (6, "same words here again now"), (7, "same words here again now"), (8, "日本語 テキスト é \U0001f642"),
    (9, "a\n <|endoftext|> b  c"), (10, "12 " * 4000), (None, "no key at all"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", None, 0, "extra", 1.0) for k, t in ODD]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (7, 8), (5, 4), (1, None)], "a int, b int")
    found = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7}
    assert connected_components(edges.limit(0)).count() == 0


def test_fingerprints(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in QUERIES["op1_order_minhash"](spark, sf_dir).collect()}
    keys = sorted(texts, reverse=True)
    for i, key in enumerate(keys):
        text, after = texts[key], texts[keys[(i + 1) % len(keys)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert found[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(found) == len(texts)
    by_text = {}
    for key, row in found.items():
        assert by_text.setdefault(texts[key], row["fingerprint"]) == row["fingerprint"]
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.2
    assert np.mean([r["near_next"] for r in found.values()]) < 0.05


def test_fingerprint_feels_order_and_odd_rows(spark, odd):
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[1500:] + words[:1500])), (2, " ".join(words[:-1]))]
    prints = dict(fingerprint.fingerprint(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    like = lambda a, b: np.mean([prints[a][8 * j : 8 * j + 8] == prints[b][8 * j : 8 * j + 8] for j in range(32)])
    assert like(0, 2) > 0.9 and like(0, 1) < 0.8 and like(0, 1) < like(0, 2)
    found = fingerprint.edit_likeness(odd).collect()
    assert len(found) == len(ODD)
    assert {r["fingerprint"] for r in found if r["doc_id"] in (1, 2, 3)} == {""}
    assert fingerprint.edit_likeness(odd.limit(0)).count() == 0


def test_language(spark, odd):
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {
        r["doc_id"]: r["lang"]
        for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    }
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    learned = (("aa", b"same words here again now"), ("bb", b"other text"))
    rows = language.identify(odd, learned).collect()
    by_key = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and by_key[6]["lang_pred"] == "aa"
    assert [by_key[k]["lang_pred"] for k in (1, 2, 3, 10)] == ["und"] * 4
    assert {r["lang_pred"] for r in language.identify(odd, ()).collect()} == {"und"}


def test_cross_parsing_counts_phrases():
    sample, text = b"abcabd the quick", b"abdabc quick zz the"
    parser = language.CrossParser((("l", sample),))
    count, at = 0, 0
    while at < len(text):  # the longest match at each place
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + max(1, n), count + 1
    codes = np.frombuffer(text, np.uint8)
    assert parser.phrases(codes, np.array([0, len(codes)]))[0, 0] == count


def test_site_lines(spark, sf_dir, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = sorted(con.execute(ORACLES["op3_site_lines"]).fetchall())
    columns = ["doc_id", "text", "n_lines", "n_dropped"]
    ours = sorted(map(tuple, QUERIES["op3_site_lines"](spark, sf_dir).select(*columns).collect()))
    assert ours == theirs
    rows = [(i, "h", f"menu\nbody {i}\n\nmenu") for i in range(8)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    found = {r["doc_id"]: r for r in boilerplate.drop_boilerplate(docs, ratio=0.5).collect()}
    assert found[3]["text"] == "body 3\n" and found[3]["n_dropped"] == 2 and found[99]["text"] is None
    assert boilerplate.drop_boilerplate(odd).count() == len(ODD)
    assert boilerplate.drop_boilerplate(odd.limit(0)).count() == 0


def test_small_hosts_lose_repeated_lines(spark):
    """From two pages on the ratio alone decides."""
    rows = [(i, f"h{i // 3}", f"menu\nbody {i}") for i in range(6)] + [(9, "single", "menu\nmenu")]
    found = {r["doc_id"]: r for r in boilerplate.drop_boilerplate(
        spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()}
    assert [found[i]["text"] for i in range(6)] == [f"body {i}" for i in range(6)]
    assert found[9]["text"] == "menu\nmenu" and found[9]["n_dropped"] == 0


def test_language_samples_come_from_whole_texts(spark):
    """Documents that all open alike are learned from behind their opening too; repeats count once."""
    opening = "licence terms apply " * 150
    rows = [(i, opening + f"unlike word{i} " * 200, "aa") for i in range(40)] + [(99, opening, "bb")] * 5
    samples = dict(language.sample_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string")))
    assert samples["aa"].count(b"unlike") > 100 and samples["bb"].count(b"licence") <= 101


def _simhash(text: str | None) -> int:
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf_dir, texts, odd):
    found = {r["doc_id"]: r for r in QUERIES["op4_simhash_groups"](spark, sf_dir).collect()}
    prints = {k: _simhash(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    for key in texts:
        assert found[key]["fingerprint"] == f"{prints[key]:016x}" and found[key]["component_id"] == root(key)
    kept = [r["doc_id"] for r in simhash.keep_representatives(odd).collect()]
    assert sorted(k for k in kept if k) == [1, 4, 5, 6, 8, 9, 10] and None in kept
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_rows_are_kept_by_row_not_by_key(spark):
    """A text of its own under the key of a near copy stays; copies without a key go."""
    first, second, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, first), (2, first), (2, second), (None, first), (None, third), (None, third), (3, second), (3, third)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(map(tuple, simhash.keep_representatives(docs).collect()))
    assert kept == [(1, first), (2, second), (3, third)]


def test_large_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    prints = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (60, 2))})
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    found = {r["id"]: r["component"] for r in connected_components(simhash.close_links(df)).collect()}
    label = {p: p for p in prints}
    for _ in range(8):
        for a in prints:
            label[a] = min(label[b] for b in prints if (a ^ b).bit_count() <= 4)
    assert {p: found.get(p, p) for p in prints} == label


def _edited_texts():
    """Texts of 300 words, and beside each a copy with 1 to 12 words replaced; a chain; a text of its own."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    out = []
    for n in range(60):
        words = [word() for _ in range(300)]
        out.append(" ".join(words))
        for at in rng.choice(300, 1 + n % 12, replace=False):
            words[at] = word()
        out.append(" ".join(words))
    words = [word() for _ in range(300)]
    for at in range(0, 60, 10):
        out.append(" ".join(words))
        words[at : at + 25] = [word() for _ in range(25)]
    return [*out, " ".join(word() for _ in range(300)), "", None, "one two"]


def _kept_by_simhash(texts):
    """Brute force: the least key of each group of ``{key: text}`` linked at 4 or fewer differing bits."""
    keys = sorted(texts)
    prints = simhash.fingerprint_texts([texts[k] for k in keys])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label, before = np.arange(len(keys)), None
    while before is None or (label != before).any():
        before, label = label, np.array([label[row].min() for row in near], int)
    return [keys[i] for i in sorted(set(label.tolist()))]


def test_pipeline_near_dedup_by_simhash(spark, monkeypatch):
    import corpus_pipeline

    texts = dict(enumerate(_edited_texts()))
    rows = [(i, t, "x", None, 0) for i, t in texts.items()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    wanted = _kept_by_simhash(texts)
    assert len(texts) // 2 < len(wanted) < len(texts) - 5
    for size in (1024, 4):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", size)
        kept = corpus_pipeline.near_dedup(spark, docs, "")
        assert kept.columns == corpus_pipeline.COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == wanted


def test_near_dedup_keeps_columns_of_any_name(spark, odd):
    docs = odd.withColumns({n: F.lit(n) for n in ("component_id", "fingerprint", "_row", "_Group", "_key")})
    found = simhash.keep_representatives(docs)
    assert found.columns == docs.columns and found.count() == simhash.keep_representatives(odd).count()
    assert {r["_Group"] for r in found.collect()} == {"_Group"}


def test_substring_dedup(spark, odd):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(20 + i)} {passage} {words(15)} é") for i in range(6)] + [(50, words(200))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: r for r in chunks.drop_repeats(docs).collect()}
    assert found[0]["n_spans"] == 0 and found[0]["text"] == rows[0][1] and found[50]["removed_bytes"] == 0
    for key, text in rows[1:6]:
        row = found[key]
        assert row["n_spans"] == 1 and len(passage) <= row["removed_bytes"] <= len(passage) + 6
        assert len(text.encode()) - len(row["text"].encode()) == row["removed_bytes"]
        assert text.startswith(row["text"][:60]) and text.endswith(row["text"][-30:])
    kept = chunks.drop_repeats(odd).collect()
    assert len(kept) == len(ODD) and chunks.drop_repeats(odd.limit(0)).count() == 0
    clash = chunks.drop_repeats(odd.withColumns({n: F.lit(n) for n in ("_key", "_H", "_spans", "start")}))
    assert {(r["_key"], r["_H"], r["_spans"]) for r in clash.collect()} == {("_key", "_H", "_spans")}


def _spans_by_hand(texts, min_repeat=chunks.MIN_REPEAT):
    """``{key: [(start, size)]}`` of ``{key: bytes}``, one chunk and one byte after the other."""
    first, out = {}, {}
    for key in sorted(texts):
        data = texts[key]
        ends = chunks.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1].tolist()
        repeated, start = [], 0
        for end in ends:
            place = first.setdefault(data[start:end], (key, start))
            if place != (key, start):
                repeated.append((start, end, place))
            start = end
        hit = np.zeros(len(data) + 1, bool)
        for i, (start, end, (other, at)) in enumerate(repeated):
            hit[start:end] = True
            there = texts[other]
            if i == 0 or repeated[i - 1][1] != start:
                n = 0
                while n < min(start, at) and data[start - n - 1] == there[at - n - 1]:
                    n += 1
                while n and data[start - n] & 0xC0 == 0x80:
                    n -= 1
                hit[start - n : start] = True
            if i + 1 == len(repeated) or repeated[i + 1][0] != end:
                n, at = 0, at + end - start
                while end + n < len(data) and at + n < len(there) and data[end + n] == there[at + n]:
                    n += 1
                while n and end + n < len(data) and data[end + n] & 0xC0 == 0x80:
                    n -= 1
                hit[end : end + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(int))).reshape(-1, 2).tolist()
        out[key] = [(a, b - a) for a, b in edges if b - a >= min_repeat]
    return out


@pytest.mark.parametrize("edge", [256, 5])
def test_repeated_spans_against_brute_force(spark, sf_dir, texts, monkeypatch, edge):
    monkeypatch.setattr(chunks, "EDGE_BYTES", edge)
    rng = np.random.default_rng(7)
    letters = [*map(chr, range(97, 123)), "é", "ß", "日", "\U0001f642"]
    words = lambda n: " ".join("".join(rng.choice(letters, 5)) for _ in range(n))
    passages = [words(40) for _ in range(12)]
    own = {100_000 + i: " ".join([words(9 + i % 7), passages[i % 12], words(5), passages[(i * 5 + 1) % 12], words(i % 3)]) for i in range(60)}
    own |= {200_000: "é" * 900, 200_001: "a" + "é" * 700 + "b", 200_002: "", 200_003: own[100_007]}
    held = {**{k: t or "" for k, t in texts.items()}, **own}
    docs = spark.createDataFrame(list(held.items()), "doc_id bigint, text string").repartition(5)
    wanted = _spans_by_hand({k: t.encode() for k, t in held.items()})
    found = {r["doc_id"]: [(s["start"], s["size"]) for s in r["spans"]] for r in chunks.repeated_spans(docs).collect()}
    assert found == wanted
    # of the planted passages that stand in an earlier text too, nearly every byte goes
    seen, lost, total = set(), 0, 0
    for i in range(60):
        data = own[100_000 + i].encode()
        for n in (i % 12, (i * 5 + 1) % 12):
            passage, before = passages[n].encode(), (n in seen)
            seen.add(n)
            if before:
                at = data.index(passage)
                covered = np.zeros(len(data), bool)
                for start, size in found[100_000 + i]:
                    covered[start : start + size] = True
                total += len(passage)
                lost += int((~covered[at : at + len(passage)]).sum())
    assert total > 10_000 and lost < 0.05 * total
    if edge == 256:
        kept = {r["doc_id"]: r for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
        alone = _spans_by_hand({k: (t or "").encode() for k, t in texts.items()})
        for key, row in kept.items():
            data = (texts[key] or "").encode()
            mask = np.ones(len(data), bool)
            for start, size in alone[key]:
                mask[start : start + size] = False
            assert (row["text"] or "").encode() == np.frombuffer(data, np.uint8)[mask].tobytes()
            assert row["n_spans"] == len(alone[key]) and row["removed_bytes"] == (~mask).sum()


def test_packing(spark, sf_dir, texts, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_packed_windows"](spark, sf_dir).collect()
    for key, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for row in sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"]):
            piece = np.array(ids[at : at + row["length"]], "<u4").tobytes()
            assert row["start"] == at and row["doc_tokens"] == len(ids) and row["ids_crc32"] == zlib.crc32(piece)
            at += row["length"]
        assert at == len(ids)
    used = {}
    for row in sorted(rows, key=lambda r: r["offset"]):
        assert used.get(row["sequence_id"], 0) == row["offset"]
        used[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(used.values()) <= 2048
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in found) == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD
    )
    assert packing.pack(odd.limit(0), path).count() == 0


@pytest.mark.parametrize("tokens", [5, 20, 40])
def test_short_documents_are_packed_tightly(tokens):
    sizes = np.random.default_rng(4).poisson(tokens, 30_000) + 1
    first = sizes[: np.searchsorted(np.cumsum(sizes), packing.GROUP)]  # what a task groups
    assert len(first) <= packing.GROUP_PIECES
    windows = packing.fill_windows(first).max() + 1
    assert first.sum() > 0.97 * windows * packing.WINDOW


def test_differencing_balances():
    slots, sums = packing.multiway_differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16] and len(slots) == 5
    sizes = np.random.default_rng(0).integers(1, 513, 500)
    places = packing.fill_windows(sizes)
    assert np.bincount(places, sizes).max() <= 2048 and places.min() >= 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = base[:10] + 0.05 * rng.normal(size=(10, 8))
    data = [list(map(float, v)) for v in [*base, *near, base[0], base[0]]]
    rows = [(i, v, 0) for i, v in enumerate(data)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [None] * 8, 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    unit = np.array(data, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    label = np.arange(len(unit))
    for _ in range(10):
        label = np.array([label[row].min() for row in linked])
    for i in range(len(unit)):
        assert found[i]["n_links"] == linked[i].sum() - 1 and found[i]["component_id"] == label[i]
        assert found[i]["kept"] == (label[i] == i)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 905))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_keep_chains_and_bridges_whole(spark, monkeypatch):
    """One component needs links between vectors that both have a smaller neighbour."""
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    chain = [0, 60, 20, 40]
    clumps = [*(120 + np.arange(9) / 10), *(141 + np.arange(9) / 10), 240, 180, 200, 220]
    data = np.array([turn(x) for x in [*chain, *clumps]])
    rng = np.random.default_rng(4)
    linked = data @ data.T >= 0.93
    label = np.arange(len(data))
    for _ in data:
        label = np.array([label[row].min() for row in linked])
    assert label[:4].tolist() == [0] * 4 and len(set(label)) < 4
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id bigint, embedding array<double>")
    for size in (1024, 4):  # all in one block, and over pairs of blocks
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        found = {r["vec_id"]: r for r in vectors.near_vectors(df, threshold=0.93).collect()}
        for i in range(len(data)):
            assert found[i]["component_id"] == label[i] and found[i]["n_links"] == linked[i].sum() - 1
    mask = rng.random((30, 40)) < 0.04
    halves = list(vectors._spanning([(np.arange(30), mask), (np.arange(30, 70), mask.T)]))
    edges = [(n + first, int(p)) for first, (some, to) in zip((0, 30), halves) for n, p in zip(some.tolist(), to) if n + first != p]
    assert all(mask[min(e), max(e) - 30] for e in edges)
    group = list(range(70))
    for a, b in edges:
        assert group[a] != group[b]  # a forest: no edge closes a ring
        group = [group[a] if g == group[b] else g for g in group]
    assert all(group[a] == group[30 + b] for a, b in np.argwhere(mask))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _base_spans(text: str) -> list[str]:
    def good(kind, hit):
        digits = [int(c) for c in hit if c in "0123456789"]
        if kind == "card":
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        if kind == "phone":
            return 9 <= len(digits) <= 15
        return kind != "ip" or all(int(p) <= 255 for p in hit.split("."))

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text) if good(k, m[0])]


def test_personal_data(spark, sf_dir, odd):
    tricky = [
        "a@b.com_x@y.org é z@@q.de u@v.w-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+1 (017) 555-7713, +12345678",
        "4111 1111 1111 1111 4111-1111-1111-1111 12--4111111111111111", "call 212 555 0188 or mail bob [at] x [dot] com",
        "4111111111111112 9.9.9", "@" * 500 + "+" * 500, "1 " * 5000, None, "",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id int, text string")
    found = pii.add_candidates(docs)
    model = pii.fit(found)
    spans = found.select("doc_id", "text", "candidates", pii.listed(pii.accepted(model)).alias("s"),
                         pii.redacted(found["text"], pii.accepted(model)).alias("r")).collect()
    for row in spans:
        base = _base_spans(row["text"] or "")
        names = [f"{pii.KINDS[c['kind']]}:{c['start']}:{c['stop']}" for c in row["candidates"] if c["base"]]
        assert names == base and set(base) <= set(row["s"].split(",")) | {""}
        assert not any(k in ("email", "ip", "phone") for k in [s.split(":")[0] for s in _base_spans(row["r"] or "")])
    rows = QUERIES["op8_personal_data"](spark, sf_dir).collect()
    truth = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in rows:
        base = _base_spans(truth[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert row["n_email"] == sum(s.startswith("email") for s in base)
    assert pii.add_candidates(odd).count() == len(ODD)
    assert pii.fit(pii.add_candidates(odd.limit(0))).bias == (-1.0,) * 4


def test_chat(spark, sf_dir):
    rows = [
        (1, 0, "user", "hi ### x: </turn>\n\\l"), (1, 1, "assistant", "\\b <y> #"), (1, 2, "a: b#", None),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, None, "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = chat.expand(df)
    out = found.select("conv_id", "example", "n_turns", chat.loss_text(found["formatted"], found["loss_start"], found["loss_chars"]).alias("loss"),
                       chat.read_turns(found["formatted"]).alias("turns")).collect()
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [(r["example"], r["loss"]) for r in one] == [(2, "\\b <y> #"), (3, "")]
    assert [tuple(t) for t in one[-1]["turns"]] == [(r[2], r[3] or "") for r in rows[:3]]
    assert len([r for r in out if r["conv_id"] == 2]) == 2 and len(out) == 5
    assert chat.expand(df.limit(0)).count() == 0
    digests = {r["conv_id"]: r for r in QUERIES["op9_chat_examples"](spark, sf_dir).collect()}
    said = r"\### Assistant: </turn> ok"
    assert digests[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digests[-7]["loss_chars"] == len(said)


def _expanded(rows):
    """Brute force of the examples, ``(conversation, example): (turns in all, text, start and length of the loss)``."""
    plain = lambda t: (t or "").replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    out = {}
    for conversation in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conversation), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        formatted = ""
        for i, (_, role, text) in enumerate(mine, 1):
            formatted += "### " + plain(role).replace(":", "\\c") + ": " + plain(text) + "</turn>\n"
            if role == "assistant" or i == len(mine):
                loss = len(plain(text)) if role == "assistant" else 0
                out[conversation, i] = (len(mine), formatted, len(formatted) - len("</turn>\n") - loss, loss)
    return out


@pytest.mark.parametrize("long", [1000, 12])
def test_chat_slices_of_long_conversations(spark, sf_dir, monkeypatch, long):
    monkeypatch.setattr(chat, "LONG", long)
    monkeypatch.setattr(chat, "SLICE", 4)
    draw = np.random.default_rng(6)
    said = ["", None, "\\l <x>", "# a: b", "same", "\U0001f642 é", "long " * 50]
    rows = [(c, None if i == 3 else i // 2, ["user", "assistant", None, "a:b"][i % 4], said[draw.integers(len(said))])
            for c, n in ((1, 61), (2, 12), (3, 13), (4, 48), (None, 30), (5, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    df = df.withColumns({name: df["turn"] for name in ("_key", "n_turns", "_at", "_slice", "formatted", "_long")})
    found = chat.expand(df.repartition(5)).collect()
    made = {(r["conv_id"], r["example"]): (r["n_turns"], r["formatted"], r["loss_start"], r["loss_chars"]) for r in found}
    assert len(made) == len(found) and made == _expanded(rows)


def test_chat_query_against_brute_force(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = QUERIES["op9_chat_examples"](spark, sf_dir).collect()
    assert {r["conv_id"] for r in found} == {r[0] for r in rows} and len(found) == len({r[0] for r in rows})
    chars = {}
    for (conversation, _), (_, formatted, _, _) in _expanded(rows).items():
        chars[conversation] = chars.get(conversation, 0) + len(formatted)
    for r in found:
        mine = sorted((x[1:] for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        loss = "".join(x[2] or "" for x in mine if x[1] == "assistant")
        whole = "".join(f"{x[1] or ''}\n{x[2] or ''}\n" for x in mine)
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), digest(whole))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss))
        assert r["formatted_chars"] == chars[r["conv_id"]]


def test_bpe(spark, sf_dir, texts, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = QUERIES["op10_bpe_round_trip"](spark, sf_dir).collect()
    for row in rows:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    found = bpe.decode(bpe.encode(odd, path), path).collect()
    expected = [library.encode(t or "", add_special_tokens=False).ids for _, t in ODD]
    assert sorted(r["ids"] for r in found) == sorted(expected)
    assert bpe.decode(bpe.encode(odd.limit(0), path), path).count() == 0
    bpe_ = bpe.load_bpe(path)
    rng = np.random.default_rng(4)
    letters = list("abcdeoinst' .,ΣÉé́ß日0\U0001f642\n")
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe_.ids(text), "<i4").tolist() == ids


def test_pipeline(spark, sf_dir, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    for row in pieces:
        assert 0 <= row["offset"] <= 2048 - row["length"]
    # brute force of who is left: one document of each group that SimHash links
    left = corpus_pipeline.language_id(spark, docs, sf_dir)
    lines = corpus_pipeline.line_dedup(spark, left, sf_dir).collect()
    wanted = _kept_by_simhash({r["doc_id"]: r["text"] for r in lines})
    assert {r["doc_id"] for r in pieces} == set(wanted) and len(wanted) > len(lines) // 2
    empty = odd.limit(0).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
