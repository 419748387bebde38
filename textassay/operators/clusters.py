"""Agreement of clusters with labels, and their separation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.session import materialise, sized


def _pairs(n: Column) -> Column:
    """Pairs among ``n`` things; double, so that large groups can not overflow."""
    m = n.cast("double")
    return m * (m - 1) / 2


def adjusted_rand(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row ``ari``; 1 when both sides put everything in one group."""
    cells = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    # one more row per marginal: grouping sets of the contingency table
    marginals = cells.groupingSets(
        [[F.col(label), F.col(cluster)], [F.col(label)], [F.col(cluster)], []], label, cluster
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    sums = marginals.agg(
        *[
            F.sum(F.when(F.col("level") == level, _pairs(F.col("n")))).alias(name)
            for level, name in ((0, "cells"), (1, "rows"), (2, "columns"), (3, "whole"))
        ]
    )
    whole, rows, columns = F.col("whole"), F.col("rows"), F.col("columns")
    expected = F.when(whole > 0, rows * columns / whole).otherwise(F.lit(0.0))
    top, bottom = F.col("cells") - expected, (rows + columns) / 2 - expected
    return sums.select(F.when(bottom != 0, top / bottom).otherwise(F.lit(1.0)).alias("ari"))


BLOCK_ROWS = 1024  # vectors that are compared at once
CHUNK_ROWS = 32 * BLOCK_ROWS  # vectors of one side of a pair of chunks, at most


def euclidean_silhouette(
    df: DataFrame, key: str, cluster: str, vector: str, rows: int | None = 10_000, seed: int = 42
) -> DataFrame:
    """One row ``(n, silhouette)``: the mean silhouette by plain Euclidean distance.

    Every vector is compared with every other, so by default only the ``rows`` rows of least seeded hash take part;
    with ``None`` all do. Vectors are dealt to chunks, two for each core and of at most ``CHUNK_ROWS``; a vector is
    sent once for each chunk, not for each block, and a task has whole pairs of chunks and gives sums of
    distances per vector and cluster. A cluster of one counts 0. Rows without a
    vector or cluster are left out; with fewer than two clusters the value is null.
    """
    kept = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("vector"), F.col(key).alias("_key")
    )
    order = F.md5(F.concat(F.col("_key").cast("string"), F.lit(f":{seed}")))
    if rows is not None:
        kept = kept.orderBy(order, "_key").limit(rows)
    kept = materialise(kept.withColumn("row", F.monotonically_increasing_id()), "silhouette_rows")
    sizes = materialise(kept.groupBy("cluster").agg(F.count("*").alias("size")), "cluster_sizes")
    n_rows = kept.count()
    chunks = max(1, -(-n_rows // CHUNK_ROWS), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // BLOCK_ROWS)))
    packed = kept.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.collect_list("row").alias("rows"), F.collect_list("cluster").alias("clusters"),
        F.collect_list("vector").alias("vectors"),
    )
    packed = materialise(packed, "vector_chunks")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = packed.select(F.col("chunk").alias("left"), every.alias("right"), "rows", "clusters", "vectors")
    right = packed.select(
        F.col("chunk").alias("right"), every.alias("left"), F.col("rows").alias("o_rows"),
        F.col("clusters").alias("o_clusters"), F.col("vectors").alias("o_vectors"),
    )
    tasks = max(1, chunks * chunks // 2)
    joined = left.repartition(tasks, "left", "right").join(
        right.repartition(tasks, "left", "right").hint("merge"), ["left", "right"]
    )
    step = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(name)[i].values
                matrix = lambda name: np.array(cell(name).flatten()).reshape(len(cell(name)), -1)
                kinds = cell("o_clusters").dictionary_encode()
                code = kinds.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                code, b = code[order], matrix("o_vectors")[order]
                a, numbers, own = matrix("vectors"), cell("rows"), cell("clusters")
                others = np.array(cell("o_rows"))[order]
                b_squares = (b * b).sum(axis=1)
                for low in range(0, len(a), step):
                    some = a[low : low + step]
                    mine = np.array(numbers[low : low + step])
                    squares = (some * some).sum(axis=1)[:, None]
                    totals = np.zeros((len(some), len(kinds.dictionary)))
                    for at in range(0, len(b), step):
                        distances = squares + b_squares[at : at + step] - 2 * some @ b[at : at + step].T
                        distances = np.sqrt(np.maximum(distances, 0))
                        if batch.column("left")[i] == batch.column("right")[i]:
                            distances[mine[:, None] == others[at : at + step]] = 0
                        found, starts = np.unique(code[at : at + step], return_index=True)
                        totals[:, found] += np.add.reduceat(distances, starts, axis=1)
                    each, width = np.arange(len(some)), totals.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(mine, width)),
                            own[low : low + step].take(pa.array(np.repeat(each, width))),
                            kinds.dictionary.take(pa.array(np.tile(np.arange(width), len(some)))),
                            pa.array(totals.ravel()),
                        ],
                        names=["row", "cluster", "o_cluster", "total"],
                    )

    kind = dict(kept.dtypes)["cluster"]
    sums = joined.mapInArrow(run, f"row bigint, cluster {kind}, o_cluster {kind}, total double")
    per = sums.groupBy("row", "cluster", "o_cluster").agg(F.sum("total").alias("total"))
    o_sizes = sizes.select(F.col("cluster").alias("o_cluster"), F.col("size").alias("o_size"))
    per = per.join(sized(sizes), "cluster").join(sized(o_sizes), "o_cluster")
    own = F.col("cluster") == F.col("o_cluster")
    each = per.groupBy("row").agg(
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("o_size"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    far = F.greatest(a, b)
    value = F.when(b.isNotNull(), F.when(a.isNull() | (far == 0), F.lit(0.0)).otherwise((b - a) / far))
    return each.agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))
