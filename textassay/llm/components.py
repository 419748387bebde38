"""Connected components of an edge table, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.session import materialise


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(found)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), "m")
    return smaller.unionAll(least.select("a", "m")).select("a", F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``, component being the least id reachable.

    Alternates large and small stars until nothing changes, which takes a number
    of rounds logarithmic in the number of nodes. Each round's edges are stored, so a lost
    executor repeats one round at most. Nodes without an edge do not appear; loops,
    repeated edges and edges with a null end are ignored. Minima are combined
    before the shuffles; a hub is met only in joins, where Spark splits it.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(
        clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return nodes.unionAll(roots)


def one_row_each(rows: DataFrame, group: str, key: str, row: str) -> DataFrame:
    """Of each ``group`` the row with the least ``key``, null keys last, then the least ``row``."""
    order = F.struct(F.col(key).isNull(), F.col(key), F.col(row).alias("_row"))
    winners = rows.groupBy(group).agg(F.min(order).alias("_first")).select(F.col("_first._row").alias(row))
    return rows.join(winners, row, "left_semi")
