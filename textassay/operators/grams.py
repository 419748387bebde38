"""Word n-grams counted, dealt and looked up as packed blocks of many terms.

A term row of its own, shuffled and sorted as a string, costs more than all else that is done with it. So the n-grams of
a block of documents are formed and counted at once, its distinct terms are dealt to ``parts`` by their characters, and
what travels is one row per block and part: the terms themselves (never a hash in their place), packed and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.session import shuffle_partitions

BLOCK_WORDS = 1 << 17  # of a block of documents, about
PART_TERMS = 1 << 22  # terms of a part, about, repeats in other blocks included
ROWS = 1 << 16  # of a batch that is handed on
SIZES = (1, 2, 3)  # words of an n-gram


def count_grams(lists: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of some rows' words, and ``(row, term, times)`` sorted by row: how often each occurs in it.

    The n-grams are those of :func:`textassay.functions.text.ngrams`; null words make none of their own.
    """
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    words = lists.flatten().cast(pa.string())
    row = np.repeat(np.arange(len(lengths)), lengths)
    found, rows = [], []
    for n in SIZES:
        count = max(len(words) - n + 1, 0)
        if n == 1:
            made, whole = words, pc.is_valid(words).to_numpy(zero_copy_only=False)
        else:
            parts = [words.slice(k, count) for k in range(n)]
            made = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
            whole = row[:count] == row[len(row) - count :]
        found.append(made if whole.all() else made.filter(pa.array(whole)))
        rows.append(row[:count][whole])
    coded = pa.concat_arrays(found).dictionary_encode()
    terms = coded.dictionary
    pairs = np.concatenate(rows) * max(len(terms), 1) + coded.indices.to_numpy()
    pairs, times = np.unique(pairs, return_counts=True)
    return terms, pairs // max(len(terms), 1), pairs % max(len(terms), 1), times


def part_of(terms: pa.StringArray, parts: int) -> np.ndarray:
    """The part that each term belongs to, by its length and its first, middle and last eight bytes."""
    terms = pa.concat_arrays([terms])
    if not len(terms):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1 + terms.offset)[terms.offset :].astype(np.int64)
    used = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    flat = np.concatenate([used, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    length = np.diff(offsets)
    beyond = np.maximum(length - 8, 0)
    mask = np.where(length >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1))
    mixed = length.astype(np.uint64)
    for at in (0, beyond // 2, beyond):
        mixed = (mixed ^ (eight[offsets[:-1] + at] & mask)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(numbers).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(cell, kind) -> np.ndarray:
    """The numbers that :func:`pack` made a cell of."""
    raw = cell.as_buffer()
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd") if size else b"", kind)


def pack_terms(terms: pa.StringArray) -> bytes:
    """Lengths, then characters."""
    terms = pa.concat_arrays([terms])
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1 + terms.offset)[terms.offset :]
    used = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    head = np.array([len(terms)], np.uint32).view(np.uint8)
    return pack(np.concatenate([head, np.diff(offsets).astype(np.uint32).view(np.uint8), used]))


def unpack_terms(cell) -> pa.StringArray:
    raw = unpack(cell, np.uint8)
    count = int(raw[:4].view(np.uint32)[0])
    lengths = raw[4 : 4 + 4 * count].copy().view(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 4 * count :]))


def dealt(terms: pa.StringArray, parts: int) -> list[tuple[int, np.ndarray]]:
    """``(part, places)`` of the parts that some of the terms belong to, in their order."""
    part = part_of(terms, parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[low:high]) for p, (low, high) in enumerate(zip(ends, ends[1:])) if low < high]


def parts_for(df: DataFrame, terms: int) -> int:
    """How many parts ``terms`` terms are dealt to."""
    return max(shuffle_partitions(df.sparkSession), -(-terms // PART_TERMS))


def blocks_of(batches: Iterator[pa.RecordBatch], words: str, key: str | None = None) -> Iterator[pa.Table]:
    """Rows of batches put together, or cut, to blocks of about ``BLOCK_WORDS`` words; rows of one ``key`` in a row stay together."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.list_value_length(batch.column(words)).fill_null(0).to_numpy(zero_copy_only=False)
        before = np.cumsum(lengths) - lengths
        start = 0
        while start < batch.num_rows:
            room = BLOCK_WORDS - size
            end = int(np.searchsorted(before - before[start], max(room, 1), side="left"))
            if key is not None and end < batch.num_rows:
                end = _end_of_key(batch.column(key), end, start)
            if held and key is not None and size >= BLOCK_WORDS:
                end = _end_of_key(batch.column(key), start, start, held[-1].column(key)[-1])
            if end > start:
                held.append(batch.slice(start, end - start))
                size += int(lengths[start:end].sum())
            start = end
            if start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _end_of_key(keys: pa.Array, end: int, start: int, last=None) -> int:
    """The first place from ``end`` on whose key is not that of the row before (``last`` before the first row)."""
    last = keys[end - 1] if end > start else last
    while end < len(keys) and last is not None and keys[end].as_py() == last.as_py():
        end += 1
    return end


def term_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``(term, df)``: in how many rows of ``docs (terms)`` each n-gram occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, "terms"):
            terms, _, code, _ = count_grams(block.column("terms").chunk(0))
            n = np.bincount(code, minlength=len(terms))
            for p, at in dealt(terms, parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([pack_terms(terms.take(pa.array(at)))], pa.binary()),
                     pa.array([pack(n[at])], pa.binary())],
                    names=["p", "terms", "n"],
                )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for p, terms, n in zip(*(batch.column(c) for c in ("p", "terms", "n"))):
                by_part.setdefault(p.as_py(), []).append((unpack_terms(terms), unpack(n, np.int64)))
        for held in by_part.values():
            coded = pa.concat_arrays([terms for terms, _ in held]).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([n for _, n in held])).astype(np.int64)
            yield from in_batches([coded.dictionary, pa.array(n)], ["term", "df"])

    partial = docs.select("terms").mapInArrow(counted, "p int, terms binary, n binary")
    return partial.repartitionById(parts, "p").mapInArrow(summed, "term string, df bigint")


def in_batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(start, ROWS) for c in columns], names=names)


def word_total(docs: DataFrame) -> tuple[int, int]:
    """Rows of ``docs (terms)`` and words in them."""
    sums = docs.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("terms"), F.lit(0))).alias("words")).first()
    return sums["n"], sums["words"] or 0
