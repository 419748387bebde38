"""Substring dedup: content-defined chunks by a gear hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.llm.components import slices
from textassay.session import materialise

MIN_BYTES = 24
MAX_BYTES = 128
CUT_BITS = 4  # a cut is found every 2 ** CUT_BITS bytes on average, after the minimum
MIN_REPEAT = 96  # bytes that count as a repeated passage
DIGEST_BYTES = 12  # two of the 2.5e12 chunks of 100 TB are alike by chance once in 25,000 times
EDGE_BYTES = 256  # bytes beside a run that are compared at first; eight times as many while all are equal
_WINDOW = 16  # bytes that a cut depends on; shorter than the shortest chunk

_GEAR = np.array(
    [int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)],
    np.uint32,
)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut, in a run of bytes.

    The gear hash ``h = 2 h + gear[byte]`` looked at in its bit 15 and below depends on
    the last 16 bytes only, so it is summed over windows of 1, 2, 4, 8 and 16.
    """
    rolled = _GEAR[data]
    width = 1
    while width < _WINDOW:
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
        width *= 2
    mask = np.uint32(((1 << CUT_BITS) - 1) << (_WINDOW - CUT_BITS))
    found = (rolled & mask) == 0
    found[:-1] &= (data[1:] & 0xC0) != 0x80  # not inside a character
    return np.flatnonzero(found) + 1


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, end)`` of all chunks of documents that lie one after the other."""
    places = cut_places(data).tolist() if len(data) else []
    owners, ends = [], []
    at, count = 0, len(places)
    octets = data.tobytes()
    for doc, (begin, stop) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        while begin < stop:
            low, high = begin + MIN_BYTES, begin + MAX_BYTES
            while at < count and places[at] < low:
                at += 1
            end = places[at] if at < count and places[at] < high else high
            if end >= stop:
                end = stop
            else:
                while octets[end] & 0xC0 == 0x80:
                    end -= 1
            owners.append(doc)
            ends.append(end)
            begin = end
    return np.array(owners, np.int64), np.array(ends, np.int64)


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, _h, n_bytes, starts, sizes, digests)``: each row's text hash, and the places in UTF-8 of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            octets = b"".join(texts)
            owners, ends = chunk_ends(np.frombuffer(octets, np.uint8), starts)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            digest = hashlib.blake2b
            digests = [
                digest(octets[a:b], digest_size=DIGEST_BYTES).digest()
                for a, b in zip(begins.tolist(), ends.tolist())
            ]
            rows = pa.array(np.searchsorted(owners, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(rows, v)
                for v in (
                    pa.array((begins - starts[owners]).astype(np.int32)),
                    pa.array((ends - begins).astype(np.int32)),
                    pa.array(digests, pa.binary()),
                )
            ]
            sizes = pa.array(np.diff(starts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), sizes, *lists],
                names=[key, "_h", "n_bytes", "starts", "sizes", "digests"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, F.xxhash64(text).alias("_h")).mapInArrow(
        run, f"`{key}` {kind}, _h bigint, n_bytes bigint, starts array<int>, sizes array<int>, digests array<binary>"
    )


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(and_, [F.col(left + c).eqNullSafe(F.col(right + c)) for c in names])


def _kinds(df: DataFrame, names: list[str], prefix: str = "") -> str:
    return ", ".join(f"`{prefix}{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _runs(repeated: DataFrame, ids: list[str]) -> DataFrame:
    """One row per run of neighbouring repeated chunks: ``(ids, n_bytes, start, stop)`` and, as ``_left_*``
    and ``_right_*``, where the first copies of its first and of its last chunk begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(ids) + 1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten()))
            start, size, first = (at[n].to_numpy().astype(np.int64) for n in ("start", "size", "_first_start"))
            opens = np.ones(len(row), bool)
            opens[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + size[:-1])
            head = np.flatnonzero(opens)
            tail = np.concatenate([head[1:], [len(row)]])[: len(head)] - 1
            own = pa.array(row[head])
            columns = [batch.column(i).take(own) for i in range(len(ids) + 1)]
            columns += [pa.array(start[head]), pa.array(start[tail] + size[tail])]
            for place, offset in ((head, first[head]), (tail, first[tail] + size[tail])):
                columns += [at[f"_first_{c}"].take(pa.array(place)) for c in ids] + [pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    sides = [f"_{side}_{c}" for side in ("left", "right") for c in [*ids, "at"]]
    names = [*ids, "n_bytes", "start", "stop", *sides]
    left, right = (f"{_kinds(repeated, ids, p)}, {p}at bigint" for p in ("_left_", "_right_"))
    return repeated.select(*ids, "n_bytes", "repeated").mapInArrow(
        run, f"{_kinds(repeated, ids)}, n_bytes bigint, start bigint, stop bigint, {left}, {right}"
    )


def _octets_at(texts: DataFrame, places: DataFrame, ids: list[str], limit: int) -> DataFrame:
    """``(ids, side, at, octets, whole)``: up to ``limit`` bytes after each place, or before it in reverse order.

    ``whole`` tells that the text goes no further. Places are grouped by text, which has at most two for each chunk.
    """
    wanted = places.groupBy(*ids).agg(F.collect_set(F.struct("side", "at")).alias("places"))
    wanted = wanted.withColumnsRenamed({c: f"_of_{c}" for c in ids})
    joined = texts.join(wanted, _same(ids, "", "_of_")).select(*ids, "octets", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, sides, ats, found, whole = [], [], [], [], []
            for row, (text, places) in enumerate(zip(batch.column(len(ids)), batch.column(len(ids) + 1).to_pylist())):
                data = text.as_py()
                for place in places:
                    side, at = place["side"], place["at"]
                    cut = data[at : at + limit] if side > 0 else data[max(at - limit, 0) : at][::-1]
                    rows.append(row)
                    sides.append(side)
                    ats.append(at)
                    found.append(cut)
                    whole.append(at + limit >= len(data) if side > 0 else at <= limit)
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(own) for i in range(len(ids))], pa.array(sides, pa.int32()),
                    pa.array(ats, pa.int64()), pa.array(found, pa.binary()), pa.array(whole, pa.bool_()),
                ],
                names=[*ids, "side", "at", "octets", "whole"],
            )

    return joined.mapInArrow(run, f"{_kinds(texts, ids)}, side int, at bigint, octets binary, whole boolean")


def common_length(own: bytes, other: bytes, side: int) -> int:
    """How many bytes agree from the start, without a part of a character at the far end."""
    least = min(len(own), len(other))
    differ = np.flatnonzero(np.frombuffer(own, np.uint8, least) != np.frombuffer(other, np.uint8, least))
    length = int(differ[0]) if len(differ) else least
    if side > 0:  # the byte after the last must begin a character
        while 0 < length < len(own) and own[length] & 0xC0 == 0x80:
            length -= 1
    else:  # the last one must
        while length and own[length - 1] & 0xC0 == 0x80:
            length -= 1
    return length


def _extensions(texts: DataFrame, runs: DataFrame, ids: list[str]) -> DataFrame:
    """``(ids, start, stop)``: the bytes beside runs that equal those beside the first copies, in each direction.

    Every edge is followed to its end: one whose bytes are all equal is looked at again with eight times as many.
    """
    def edges(side: int, at: str, name: str) -> DataFrame:
        first = [F.col(f"_{name}_{c}").alias(f"_first_{c}") for c in [*ids, "at"]]
        return runs.select(*ids, "n_bytes", F.lit(side).alias("side"), F.col(at).alias("at"), *first)

    waiting = (
        edges(-1, "start", "left").where("at > 0 and _first_at > 0")
        .union(edges(1, "stop", "right").where("at < n_bytes")).drop("n_bytes")
    )
    place = [*ids, "side", "at"]
    limit, done = EDGE_BYTES, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other, whole, side = (batch.column(n).to_pylist() for n in ("octets", "_octets", "_whole", "side"))
            lengths = [common_length(a, b, s) for a, b, s in zip(own, other, side)]
            # equal up to where one of the two was cut off, and that one goes on
            opens = [n > min(len(a), len(b)) - 4 and not w for n, a, b, w in zip(lengths, own, other, whole)]
            kept = [batch.column(n) for n in edge]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lengths, pa.int64()), pa.array(opens, pa.bool_())], names=[*edge, "length", "open"]
            )

    edge = [*place, *[f"_first_{c}" for c in [*ids, "at"]]]
    while True:
        firsts = waiting.select(*[F.col(f"_first_{c}").alias(c) for c in ids], "side", F.col("_first_at").alias("at"))
        octets = materialise(
            _octets_at(texts, waiting.select(*place).union(firsts).distinct(), ids, limit), "edge_octets"
        )
        beside = octets.select(*[F.col(c).alias(f"_b_{c}") for c in octets.columns])
        both = waiting.join(
            beside, _same([*ids, "at"], "_first_", "_b_") & (F.col("side") == F.col("_b_side"))
        ).select(*edge, F.col("_b_octets").alias("_octets"), F.col("_b_whole").alias("_other_whole"))
        both = both.join(beside, _same(place, "", "_b_")).select(
            *edge, F.col("_b_octets").alias("octets"), "_octets",
            # the shorter of the two decides
            F.when(F.octet_length("_b_octets") < F.octet_length("_octets"), F.col("_b_whole"))
            .when(F.octet_length("_b_octets") > F.octet_length("_octets"), F.col("_other_whole"))
            .otherwise(F.col("_b_whole") | F.col("_other_whole")).alias("_whole"),
        )
        schema = f"{_kinds(waiting, edge)}, length bigint, open boolean"
        measured = materialise(both.mapInArrow(run, schema), "edges")
        far = F.col("at") + F.col("side") * F.col("length")
        ended = measured.where("not open and length > 0").select(
            *ids, F.least("at", far).alias("start"), F.greatest("at", far).alias("stop")
        )
        done = ended if done is None else done.union(ended)
        waiting = measured.where("open").select(*edge)
        if waiting.isEmpty():
            return done
        limit *= 8


def _merged(pieces: DataFrame, ids: list[str], min_repeat: int) -> DataFrame:
    """``(ids, spans)``: pieces of a text that touch become one span; spans below ``min_repeat`` bytes go."""
    grouped = pieces.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("pieces"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column(len(ids)).to_pylist():
                out: list[list[int]] = []
                for piece in found:
                    if out and piece["start"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], piece["stop"])
                    else:
                        out.append([piece["start"], piece["stop"]])
                spans.append([{"start": a, "size": b - a} for a, b in out if b - a >= min_repeat])
            columns = [*batch.columns[: len(ids)], pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*ids, "spans"])

    return grouped.mapInArrow(run, f"{_kinds(pieces, ids)}, spans array<struct<start:bigint,size:bigint>>")


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT
) -> DataFrame:
    """``(key, _h, n_chunks, spans)`` for each text, ``_h`` being its hash.

    ``spans`` are the ``(start, size)`` in UTF-8 bytes of passages that repeat, at least ``min_repeat``
    bytes long: runs of chunks which all occur at an earlier place (a smaller key, or earlier in the
    same text), and the bytes on both sides of a run for as long as they equal those beside the first
    copy. Every byte of a span so has an equal one at an earlier place, and the first copy of any passage stays.
    Rows with a null key come after all others.

    Chunks are counted and their first places found before the shuffle, so a passage in a
    third of all documents is one row per task there. Only digests that repeat go on to
    the join, where Spark splits the frequent ones. Bytes beside a first copy are read once, however many copies
    there are.
    """
    whole = materialise(chunk(docs, key, text), "chunks")
    # a row is known by its key, and by its text too where keys repeat
    unique = whole.groupBy(key).count().where("count > 1").isEmpty()
    ids = [key] if unique else [key, "_h"]
    chunks = whole.select(*ids, F.explode(F.arrays_zip("starts", "sizes", "digests")).alias("c")).select(
        *ids, F.col("c.starts").alias("start"), F.col("c.sizes").alias("size"), F.col("c.digests").alias("digest")
    )
    order = F.struct(F.col(key).isNull().alias("last"), *ids, "start")
    firsts = materialise(
        chunks.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", *[F.col(f"first.{c}").alias(f"_first_{c}") for c in [*ids, "start"]]),
        "repeated_digests",
    )
    gather = F.collect_list if unique else F.collect_set  # of equal rows, one
    first = [f"_first_{c}" for c in [*ids, "start"]]
    later = (
        chunks.join(firsts, "digest")
        .where(~_same([*ids, "start"], "", "_first_"))
        .groupBy(*[F.col(c).alias(f"_of_{c}") for c in ids])
        .agg(F.sort_array(gather(F.struct("start", "size", *first))).alias("repeated"))
    )
    lengths = whole.select(*ids, "n_bytes")
    lengths = lengths if unique else lengths.distinct()
    runs = materialise(_runs(lengths.join(later, _same(ids, "", "_of_")), ids), "runs")
    texts = docs.select(key, F.encode(text, "UTF-8").alias("octets"), F.xxhash64(text).alias("_h"))
    texts = (texts if unique else texts.dropDuplicates(ids)).select(*ids, "octets")
    pieces = runs.select(*ids, "start", "stop").union(_extensions(texts, runs, ids))
    spans = _merged(pieces, ids, min_repeat).withColumnsRenamed({c: f"_of_{c}" for c in ids})
    none = F.array().cast("array<struct<start:bigint,size:bigint>>")
    found = whole.join(spans, _same(ids, "", "_of_"), "left").select(
        key, "_h", F.size("digests").cast("long").alias("n_chunks"), F.coalesce("spans", none).alias("spans")
    )
    return found if unique else found.dropDuplicates([key, "_h"])


def drop_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    Adds ``n_chunks``, ``n_spans`` and ``removed_bytes`` (columns of these names that are
    there already are replaced). A null text stays null and, like an empty one, has no
    chunks. Rows are kept even where nothing is left of their text. Rows that share
    key and text are one document repeated: the first place is theirs together.
    An insertion moves the cuts near it only, so the rest of a passage is still found. Other
    columns may have any name.
    """
    added = ["n_chunks", "n_spans", "removed_bytes"]
    clash = {n: f"_own{i}" for i, n in enumerate(docs.columns) if n.lower() in ("_key", "_h", "_spans")}
    back = {v: k for k, v in clash.items()}
    docs, key, text = docs.withColumnsRenamed(clash), clash.get(key, key), clash.get(text, text)
    spans = repeated_spans(docs, key, text, min_repeat).withColumnsRenamed({key: "_key", "spans": "_spans"})
    base = docs.drop(*added)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_h"))
    joined = base.join(spans, same, "left").drop("_key", "_h")
    octets = F.encode(text, "UTF-8")
    # what lies between the spans, each piece cut out of the bytes
    gaps = F.expr(
        "transform(sequence(0, size(_spans)), i -> named_struct("
        "'from', if(i = 0, 0L, _spans[i - 1].start + _spans[i - 1].size),"
        "'to', if(i = size(_spans), 2147483647L, _spans[i].start)))"
    )
    kept = F.array_join(
        F.transform(
            gaps,
            lambda g: F.decode(
                F.substring(octets, (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")), "UTF-8"
            ),
        ),
        "",
    )
    has = F.size("_spans") > 0
    return joined.withColumns(
        {
            text: F.when(has, kept).otherwise(F.col(text)),
            "n_chunks": F.coalesce("n_chunks", F.lit(0)),
            "n_spans": F.when(has, F.size("_spans")).otherwise(0).cast("long"),
            "removed_bytes": F.when(
                has, F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["size"])
            ).otherwise(F.lit(0).cast("long")),
        }
    ).drop("_spans").withColumnsRenamed(back)
