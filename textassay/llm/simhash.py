"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.llm.components import connected_components, one_row_each, slices
from textassay.session import materialise

SEED = 42
BITS = 64
BUCKET_ROWS = 1024  # distinct fingerprints of a block that one task compares at once
_PRIVATE = ("_row", "_key", "_group", "fingerprint", "component_id")
_FLUSH = 1 << 16  # shingle hashes held before their bits are counted


def _shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces[width - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends)]


def _majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """The fingerprints of documents with ``counts`` hashes each."""
    out = np.zeros(len(counts), np.uint64)
    sizes = np.array(counts)
    some = np.flatnonzero(sizes)
    if len(some):
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little")
        out[some] = packed.copy().view(np.uint64).ravel()
    return out


def fingerprint_texts(texts: list[str | None], width: int = 4) -> np.ndarray:
    """Unsigned fingerprints; null, empty and blank texts give zero."""
    out, hashes, counts = [], [], []
    for text in texts:
        own = _shingle_hashes(text, width) if text else []
        hashes += own
        counts.append(len(own))
        if len(hashes) >= _FLUSH:
            out.append(_majority(hashes, counts))
            hashes, counts = [], []
    out.append(_majority(hashes, counts))
    return np.concatenate(out)


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``(key, fingerprint bigint)`` for each row, repeated rows included.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a
    shingle is ``width`` words (a shorter text is one shingle). A bit is set if it is
    set in over half of the shingles' XXH64 hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = fingerprint_texts(batch.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints)], names=[key, "fingerprint"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint bigint")


def block_keys(fingerprint: Column, distance: int, spare: int) -> Column:
    """All ``(table, block)`` structs of a fingerprint.

    The bits are cut into ``distance + spare`` parts. At most ``distance`` parts
    can differ between two close fingerprints, so some ``spare`` parts are
    equal in both; there is one table for each choice of ``spare`` parts.
    """
    parts = distance + spare
    cuts = [BITS * i // parts for i in range(parts + 1)]
    tables = []
    for i, chosen in enumerate(combinations(range(parts), spare)):
        mask = 0
        for part in chosen:
            mask |= ((1 << (cuts[part + 1] - cuts[part])) - 1) << cuts[part]
        signed = mask - (1 << 64) if mask >> 63 else mask
        tables.append(
            F.struct(F.lit(i).alias("block_table"), fingerprint.bitwiseAND(F.lit(signed)).alias("block"))
        )
    return F.array(*tables)


def _link_run(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups linked within one block, each as members and a leader.

    A breadth-first search that takes a fingerprint out of the run when it is
    reached, so a dense group costs little more than one pass.
    """
    rest = prints
    while len(rest) > 1:
        leader, rest = rest[0], rest[1:]
        reached, queue = [], [leader]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                reached.append(found)
                queue.extend(found)
        if reached:
            yield np.concatenate(reached), leader


def close_links(prints: DataFrame, distance: int = 4, spare: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints within ``distance`` bits.

    ``prints`` has one row per distinct ``fingerprint``. Rows meet in blocks and every
    pair of a block is verified, but a block gives a spanning forest of its
    groups, not its pairs. A block with over ``BUCKET_ROWS`` rows is cut into
    chunks by hash, and all pairs of chunks are compared, each pair in a task of its
    own: no task holds more than two chunks and no pair is left out.
    """
    keyed = prints.select(
        "fingerprint", F.explode(block_keys(F.col("fingerprint"), distance, spare)).alias("k")
    ).select("fingerprint", "k.block_table", "k.block")
    block = ["block_table", "block"]
    large = materialise(
        keyed.groupBy(*block).count().where(F.col("count") > BUCKET_ROWS)
        .select(*block, F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("chunks")),
        "large_blocks",
    )
    if large.isEmpty():
        dealt = keyed.select("fingerprint", *block, F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        own = F.pmod(F.xxhash64("fingerprint"), "chunks").cast("int")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        dealt = (
            keyed.join(large, block, "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .select("fingerprint", *block, own.alias("own"), F.explode(every).alias("other"))
            .select(
                "fingerprint", *block, F.least("own", "other").alias("low"),
                F.greatest("own", "other").alias("high"),
            )
        )
    group = [*block, "low", "high"]
    sorted_rows = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the last group, which may go on
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in [*group, "fingerprint"]])
            if held:
                rows = np.concatenate([held.pop(), rows], axis=1)
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.any(rows[:4, 1:] != rows[:4, :-1], axis=0)) + 1
            last = int(starts[-1]) if len(starts) else 0
            held.append(rows[:, last:])
            yield from _runs(rows[4, :last], starts[:-1], distance)
        if held:
            yield from _runs(held[0][4], np.array([], int), distance)

    return sorted_rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _runs(prints: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    edges = np.concatenate([[0], starts, [len(prints)]]).astype(np.int64)
    prints = np.ascontiguousarray(prints).view(np.uint64)
    left, right = [], []
    for i in np.flatnonzero(np.diff(edges) > 1):
        for members, leader in _link_run(prints[edges[i] : edges[i + 1]], distance):
            left.append(members)
            right.append(np.full(len(members), leader, np.uint64))
    if left:
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 4,
    distance: int = 4,
    spare: int = 2,
) -> DataFrame:
    """``(key, fingerprint bigint, component_id)`` for each row of ``docs``.

    ``component_id`` is the least key reachable over links of at most
    ``distance`` differing bits. Equal fingerprints are one node, however many
    copies there are. Rows with a null key take part, but name no component: it is null only
    where all keys of a component are. An empty table gives an empty table.
    ``spare`` makes blocks narrower at the price of more tables.
    """
    prints = materialise(simhash(docs, key, text, width), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "nodes")
    parts = connected_components(close_links(nodes.select("fingerprint"), distance, spare))
    joined = nodes.join(parts.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fingerprint"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(
        joined.join(names, "component").select("fingerprint", "component_id"), "components"
    )
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least key, null keys last.

    Rows are numbered, so rows that share a key, or have none, are each judged by their own text; of
    equal keys the row that was stored first stays. Null, empty and blank texts are one group. Columns of
    any name are kept; an empty table gives no rows. Texts are shuffled once, at every size of the table.
    """
    clash = {n: f"_own{i}" for i, n in enumerate(docs.columns) if n.lower() in _PRIVATE}
    back = {v: k for k, v in clash.items()}
    docs, key, text = docs.withColumnsRenamed(clash), clash.get(key, key), clash.get(text, text)
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered_rows")
    groups = near_duplicates(rows, "_row", text, **settings).select("_row", F.col("component_id").alias("_group"))
    named = rows.select("_row", F.col(key).alias("_key")).join(groups, "_row")
    kept = materialise(one_row_each(named, "_group", "_key", "_row").select("_row"), "kept_rows")
    return rows.join(kept.hint("merge"), "_row", "left_semi").drop("_row").withColumnsRenamed(back)
