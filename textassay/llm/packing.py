"""Packing: token windows filled by multiway differencing (Karmarkar-Karp)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from textassay.llm.components import slices

WINDOW = 2048
PIECE = 512  # longest piece of a document's rest; short pieces fill windows evenly
GROUP = 64 * WINDOW  # tokens, about, that are partitioned together
GROUP_PIECES = 1 << 15  # and pieces at most, whatever their length; bounds memory
END_ID = 1
CACHED_UNITS = 150_000  # units whose ids a Python worker remembers

#: How byte-level vocabularies split a text and write a byte.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
BETWEEN_SPACES = re.compile(r"\s \s")


def byte_letters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class UnitEncoder(dict):
    """Ids of a text, remembered by the units between its spaces.

    No token of a byte-level vocabulary reaches over a space that has a
    non-space on one side, except as that token's first character, so a text's ids are those
    of its units. Texts with a special token or with a space between white space go
    to the tokenizers library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.units = tiktoken.Encoding(
            "units", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.octets = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.octets[rank] = len(token)

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.units.encode_ordinary(" " + unit), "<u4").tobytes()
        if len(unit) < 64:
            self[unit] = ids
        return ids

    def learn(self, units: list[str]) -> None:
        """Remember units, encoded together and taken apart at their last bytes."""
        inner = [u for u in units if u and len(u) < 64 and u.strip() == u]
        if not inner:
            return
        found = np.array(self.units.encode_ordinary(" " + " ".join(inner)), "<u4")
        ends = np.cumsum([1 + len(u.encode()) for u in inner])
        stops = (4 * (np.searchsorted(np.cumsum(self.octets[found]), ends) + 1)).tolist()
        octets = found.tobytes()
        self.update(zip(inner, map(octets.__getitem__, map(slice, [0, *stops], stops))))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if BETWEEN_SPACES.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self) > CACHED_UNITS:
            self.clear()
        self.learn([u for u in set(rest) if u not in self])
        head = np.array(self.units.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=4)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def multiway_differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """``(slot of each item, slot sums)`` by the largest differencing method.

    A partial partition holds one sum per window, in falling order. The two with
    the widest gap between largest and smallest sum are merged, the heaviest window of
    one with the lightest of the other, until a single partition is left.
    """
    total = len(sizes)
    heap = []
    for i in range(total):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        gap = sizes[i] if windows > 1 else 0
        heap.append((-int(gap), i, sums, nodes))
    heapq.heapify(heap)
    parents: list[tuple[int, int]] = []  # node total + j joins the two nodes parents[j]
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, order, other, others = heapq.heappop(heap)
        others = others[::-1]
        sums = sums + other[::-1]
        both = np.flatnonzero((nodes >= 0) & (others >= 0))
        merged = np.where(nodes >= 0, nodes, others)
        merged[both] = total + len(parents) + np.arange(len(both))
        parents.extend(zip(nodes[both].tolist(), others[both].tolist()))
        rank = np.argsort(-sums, kind="stable")
        sums, merged = sums[rank], merged[rank]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), order, sums, merged))
    _, _, sums, nodes = heap[0]
    slots = np.full(total + len(parents), -1, np.int64)
    held = np.flatnonzero(nodes >= 0)
    slots[nodes[held]] = held
    for j in range(len(parents) - 1, -1, -1):
        slots[list(parents[j])] = slots[total + j]
    return slots[:total], sums


def fill_windows(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of each item, no window over ``capacity``.

    Starts from as few windows as the total needs and adds windows while the
    fullest one exceeds the capacity. Items must not be larger than it.
    """
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slots, sums = multiway_differencing(sizes, windows)
        if sums[0] <= capacity:
            return slots
        windows += 1


def cut(tokens: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: full windows, then near-equal short pieces."""
    full, rest = divmod(tokens, window)
    out = [(i * window, window) for i in range(full)]
    start, parts = full * window, -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((start, length))
        start += length
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    piece: int = PIECE,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece of a document, each id of each document in exactly one piece.

    Columns: ``key``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` (the
    piece's place; a sequence is filled from 0 without gaps).

    A document is its ids followed by ``END_ID``; null and empty texts are that id
    alone. Rows are packed where they are read, in groups of ``group`` tokens (of very
    short pieces ``GROUP_PIECES``), so
    nothing is shuffled, memory is bounded by a group, and a repeated task gives
    whole sequences again. Sequences are numbered within the task; the task's number is
    in the upper bits. Rows with the same key are separate documents. An empty
    table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer)
        next_id = TaskContext.get().partitionId() << 33
        rows: list[list] = []  # key, start, ids, doc_tokens of short pieces
        held = 0  # their tokens
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            whole = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(value.as_py() or "") + end
                tokens = len(ids) // 4
                for start, length in cut(tokens, window, piece):
                    row = [name, start, ids[4 * start : 4 * (start + length)], tokens]
                    if length == window:
                        whole.append([*row, next_id, 0])
                        next_id += 1
                    else:
                        rows.append(row)
                        held += length
                if held >= group or len(rows) >= GROUP_PIECES:
                    yield _placed(rows, next_id, window)
                    next_id += len(rows)
                    rows, held = [], 0
                if len(whole) >= 2048:
                    yield _batch(whole)
                    whole = []
            if whole:
                yield _batch(whole)
        if rows:
            yield _placed(rows, next_id, window)

    def _placed(rows: list[list], first: int, window: int) -> pa.RecordBatch:
        sizes = np.array([len(row[2]) // 4 for row in rows], np.int64)
        slots = fill_windows(sizes, window)
        used: dict[int, int] = {}
        out = []
        for row, size, slot in zip(rows, sizes.tolist(), slots.tolist()):
            at = used.get(slot, 0)
            used[slot] = at + size
            out.append([*row, first + slot, at])
        return _batch(out)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        keys, starts, ids, tokens, sequences, offsets = zip(*rows)
        longs = [starts, [len(i) // 4 for i in ids], tokens, sequences, offsets]
        starts, lengths, tokens, sequences, offsets = (pa.array(x, pa.int64()) for x in longs)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, key_type), starts, lengths, pa.array(ids, pa.binary()), tokens,
             sequences, offsets],
            names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)
    schema = (
        f"`{key}` {kind.simpleString()}, start bigint, length bigint, ids binary, "
        "doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return docs.select(key, text).mapInArrow(run, schema)
