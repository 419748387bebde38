"""Embedding near-dedup: spherical k-means cells, blocked cosine products, groups of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.components import connected_components
from textassay.session import materialise

SAMPLE_ROWS = 20_000  # vectors, about, that the cells are fitted on
CELLS = 256  # most cells of one dimension
BLOCK_ROWS = 1024  # vectors of a cell that are compared at once
ITERATIONS = 8


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Rows of equal size as unit vectors in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centres. Starts from rows spread over ``rows``, whose order is the hash order."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(iterations):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.where(norms > 1e-12, norms, 1), centres)
    return centres


def _fit_cells(unique: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centres for each dimension, from a sample drawn by hash of at most about ``SAMPLE_ROWS`` rows."""
    rate = min(1.0, SAMPLE_ROWS / max(1, total))
    drawn = unique.where(
        F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30))
    ).select("node", "embedding")
    by_size: dict[int, list] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["node"] * 0x9E3779B97F4A7C15) % (1 << 64)):
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    cells = max(1, min(CELLS, -(-total // BLOCK_ROWS)))
    return {
        size: spherical_kmeans(unit_rows(pa.array(rows, pa.list_(pa.float64()))), cells)
        for size, rows in by_size.items()
    }


def _assign(unique: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``unique`` with ``size``, ``cell`` and ``near``: the cells that can hold a linked vector.

    A vector linked with x is at most ``sqrt(2 - 2 threshold)`` away from x. If its own cell is c
    it is no nearer to the centre of x's cell than to that of c, so x's products with the two
    centres differ by at most that distance times the distance of the centres.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(pc.list_value_length(lists))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                middle = centres.get(size)
                if middle is None:
                    cell = np.zeros(part.num_rows, np.int32)
                    near = [[0]] * part.num_rows
                else:
                    products = unit_rows(part.column("embedding")) @ middle.T
                    cell = products.argmax(axis=1).astype(np.int32)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * middle @ middle.T)) * reach + 1e-9
                    gaps = products.max(axis=1, keepdims=True) - products
                    near = [np.flatnonzero(ok).astype(np.int32) for ok in gaps <= apart[cell]]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([size] * part.num_rows, pa.int32()), pa.array(cell),
                     pa.array(near, pa.list_(pa.int32()))],
                    names=[*part.schema.names, "size", "cell", "near"],
                )

    fields = ", ".join(f"{n} {k}" for n, k in unique.dtypes)
    return unique.mapInArrow(run, f"{fields}, size int, cell int, near array<int>")


def _spanning(sides: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each side its linked places, and beside each the node it is reached from.

    ``sides`` has the nodes of each side and their links with the other one; a single side is linked
    with itself. A breadth-first search, a level at a time: a component of m nodes gets m - 1 edges,
    and the node it starts from is reached from itself.
    """
    waiting = [mask.any(axis=1) for _, mask in sides]
    some = [np.flatnonzero(own) for own in waiting]
    parents = [nodes.copy() for nodes, _ in sides]
    for start in some[0]:
        level, turn = np.array([start]), 0
        if not waiting[0][start]:
            continue
        waiting[0][start] = False
        while len(level):
            nodes, mask = sides[turn]
            turn = (turn + 1) % len(sides)
            near = mask[level] & waiting[turn]
            reached = np.flatnonzero(near.any(axis=0))
            parents[turn][reached] = nodes[level[near[:, reached].argmax(axis=0)]]
            waiting[turn][reached] = False
            level = reached
    return zip(some, (own[at] for own, at in zip(parents, some)))


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one pair of blocks: for each linked node its links and a node it reaches."""
    side = np.asarray(table.column("side"))
    rows = unit_rows(table.column("embedding").combine_chunks())
    node, copies = np.asarray(table.column("node")), np.asarray(table.column("copies"))
    within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    linked = rows[left] @ rows[right].T >= threshold
    if within:
        linked |= linked.T  # the two products of a pair may differ in the last place
        np.fill_diagonal(linked, False)
    sides = [(left, linked), (right, linked.T)][: 1 if within else 2]
    found, links, reached = [], [], []
    for (own, mask), (some, parents) in zip(sides, _spanning([(node[own], mask) for own, mask in sides])):
        other = right if own is left else left
        found.append(node[own[some]])
        links.append(mask[some] @ copies[other])
        reached.append(parents)
    join = lambda x: np.concatenate(x) if x else np.array([], np.int64)
    return pa.table({"node": join(found), "links": join(links), "other": join(reached)})


def _link(
    assigned: DataFrame, first: dict[tuple[int, int], tuple[int, int]], threshold: float
) -> DataFrame:
    """Links of all pairs of blocks that can have any: ``(node, links, other)``."""

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, others = [], []
            columns = (batch.column(n).to_pylist() for n in ("node", "size", "cell", "near"))
            for node, size, cell, near in zip(*columns):
                begin, blocks = first[size, cell]
                own.append(begin + (node * 0x9E3779B97F4A7C15 >> 20) % blocks)
                spans = [first[size, c] for c in {*near, cell} if (size, c) in first]
                others.append([b for start, n in spans for b in range(start, start + n)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("node", "copies", "embedding")),
                    pa.array(own, pa.int32()),
                    pa.array(others, pa.list_(pa.int32())),
                ],
                names=["node", "copies", "embedding", "own", "others"],
            )

    kind = dict(assigned.dtypes)["embedding"]
    dealt = assigned.select("node", "copies", "embedding", "size", "cell", "near").mapInArrow(
        targets, f"node bigint, copies bigint, embedding {kind}, own int, others array<int>"
    )
    pairs = dealt.select(
        "node", "copies", "embedding", "own", F.explode("others").alias("other")
    ).select(
        "node",
        "copies",
        "embedding",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    return pairs.groupBy("low", "high").applyInArrow(
        lambda table: _compare(table, threshold), "node bigint, links bigint, other bigint"
    )


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for each row.

    Two vectors of the same size are linked if their cosine in double precision is at least
    ``threshold``; all linked pairs are found. Vectors that are null, empty, zero, or have null
    or non-finite components link with nothing, and neither do rows with a null key (whose
    component is null and which are not kept). ``n_links`` counts linked
    rows, ``component_id`` is the least key reachable, and one row is kept per component. Rows that
    share a key are one node.

    Equal vectors are one vector with a number of copies. The others are assigned to
    cells of a spherical k-means fitted on a bounded sample, and cells are cut
    into blocks of about ``BLOCK_ROWS``. A vector goes to the blocks of those cells that can hold
    a vector linked with it; a task compares two blocks in one product. What comes out are
    counts and a spanning forest of each block pair's links, not pairs. Clustered vectors meet few
    cells; for vectors without any structure no exact method can leave out many.
    """
    finite = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    rows = vectors.select(key, F.col(vector).alias("embedding"))
    usable = F.col(key).isNotNull() & F.coalesce(F.size(F.col(vector)) > 0, F.lit(False))
    valid = vectors.where(usable & finite & nonzero).select(key, F.col(vector).alias("embedding"))
    unique = materialise(
        valid.groupBy("embedding").agg(
            F.min(key).cast("long").alias("node"), F.count("*").alias("copies")
        ),
        "unique_vectors",
    )
    centres = _fit_cells(unique, unique.count())
    assigned = materialise(_assign(unique, centres, threshold), "cells")
    sizes = assigned.groupBy("size", "cell").count()
    blocks = sizes.select("size", "cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    # at most CELLS rows per dimension: block numbers of each cell
    first: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    for row in blocks.orderBy("size", "cell").collect():
        first[row["size"], row["cell"]] = (at, row["blocks"])
        at += row["blocks"]
    linked = materialise(_link(assigned, first, threshold), "vector_links")
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(linked, "node", "other")
    found = (
        unique.join(counted, "node", "left")
        .join(parts.withColumnRenamed("id", "node"), "node", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    found = materialise(found, "vector_groups").withColumnRenamed("embedding", "_vector")
    joined = rows.join(
        found, (F.col("embedding") == F.col("_vector")) & F.col(key).isNotNull(), "left"
    )
    component = F.coalesce(F.col("component"), F.col(key).cast("long"))
    return joined.select(
        key,
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"),
    )
