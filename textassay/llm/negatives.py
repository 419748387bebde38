"""Hard negatives: Hilbert-ordered blocks with zone maps; interval bounds say which blocks an anchor reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.operators.ordered import top_k
from textassay.session import materialise, shuffle_partitions, sized

BLOCK_ROWS = 2048  # candidates of a block
CHUNK_ROWS = 256  # anchors that read blocks together
PAGE_BLOCKS = 512  # zone maps, about, that are tested in one product
HILBERT_BITS = 2  # bits of each dimension in the curve's key
EXACT = 1 << 53  # whole numbers below are exact in double precision


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as a double, as an array of whole numbers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; past 64 bits an ``OverflowError``."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    # as Python numbers: the absolute value of the least 64-bit number has no 64-bit form
    bound = max(-int(left.min()), int(left.max())) * max(-int(right.min()), int(right.max())) * left.shape[1]
    if bound < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return left @ right.T
    exact = left.astype(object) @ right.T.astype(object)
    return exact.astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve through the cube of ``2 ** bits`` cells a side, as byte strings.

    A cell's coordinates are turned, from the coarsest bit down, into the frame of the sub-cube
    that holds it; the Gray code of the turned bits, coarse ones first, is the place.
    """
    x = cells.astype(np.uint32).T.copy()  # (dimensions, rows)
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint32(level - 1)
        for i in range(dims):
            there = (x[i] & level) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(there, low, swap).astype(np.uint32)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry ^= np.where(x[-1] & level, np.uint32(level - 1), np.uint32(0)).astype(np.uint32)
        level >>= 1
    x ^= carry
    planes = [((x >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes), axis=0).T  # (rows, bytes)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _unpacked(packed, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(rows, size)


def _place(rows: DataFrame, bits: int = HILBERT_BITS) -> DataFrame:
    """``rows`` with ``curve``, the place of their vector; cells are the quarters of a common normal spread.

    Cell borders lie at the mean and one deviation beside it, of each vector's own components, so that no
    pass over the data comes first. Borders decide how well blocks are pruned, never what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.asarray(batch.column("size"))
            keys = np.empty(batch.num_rows, object)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if not size:
                    keys[at] = b""
                    continue
                m = _matrix(lists.take(pa.array(at))).astype(np.float64)
                spread = np.sqrt((m * m).mean(axis=1, keepdims=True)) + 1e-9
                cells = np.clip(np.floor(m / spread) + (1 << (bits - 1)), 0, (1 << bits) - 1)
                for row, key in zip(at, hilbert_keys(cells, bits)):
                    keys[row] = key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys.tolist(), pa.binary())], names=[*batch.schema.names, "curve"]
            )

    fields = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, curve binary")


BLOCK = (
    "size int, keys array<bigint>, labels array<bigint>, places array<bigint>, vectors binary, "
    "low array<bigint>, high array<bigint>"
)


def _blocks(placed: DataFrame, rows: int, name: str) -> DataFrame:
    """``placed`` in runs of up to ``rows`` neighbours on the curve, stored as one row each.

    ``low`` and ``high`` are the zone map, the least and largest value of each dimension. Equal vectors
    are told apart by a hash of their row, so that many copies fill many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], None

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            m = _matrix(table.column("vector").combine_chunks())
            one = lambda name: [np.asarray(table.column(name).fill_null(NULL_KEY))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([size], pa.int32()),
                    pa.array(one("key"), pa.list_(pa.int64())),
                    pa.array(one("label"), pa.list_(pa.int64())),
                    pa.array(one("place"), pa.list_(pa.int64())),
                    pa.array([m.tobytes()], pa.binary()),
                    pa.array([m.min(axis=0)], pa.list_(pa.int64())),
                    pa.array([m.max(axis=0)], pa.list_(pa.int64())),
                ],
                names=["size", "keys", "labels", "places", "vectors", "low", "high"],
            )

        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and sizes[start] != size:
                    yield packed()
                    held = []
                size = int(sizes[start])
                while start < end:
                    room = rows - sum(b.num_rows for b in held)
                    held.append(batch.slice(start, min(room, end - start)))
                    start += held[-1].num_rows
                    if sum(b.num_rows for b in held) == rows:
                        yield packed()
                        held = []
        if held:
            yield packed()

    total = placed.count()
    parts = max(1, min(shuffle_partitions(placed.sparkSession), -(-total // rows)))
    order = ["size", "curve", F.xxhash64("place")]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = ranged.select("size", "key", "label", "place", "vector").mapInArrow(run, BLOCK)
    return materialise(made.withColumn("block", F.monotonically_increasing_id()), name)


NULL_KEY = (1 << 63) - 1  # a null key sorts behind all others; the largest key is not told apart from it


def _read_zones(chunks: DataFrame, zones: DataFrame, needed: Callable) -> DataFrame:
    """``(chunk, block, need)``: the blocks each chunk reads and its anchors (by position) that need them.

    ``needed(row, low, high)`` gets a row of ``chunks`` and for its anchors (down) and the zones of a page
    (across) the least and largest product any row of the block can have.
    """
    pages = max(1, -(-zones.count() // PAGE_BLOCKS))
    page = F.pmod(F.xxhash64("block"), F.lit(pages))
    paged = zones.groupBy("size", page.alias("page")).agg(
        F.collect_list(F.struct("block", "low", "high")).alias("zones")
    )
    paged = materialise(paged, "zone_pages")
    chunks = chunks.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in one.schema.names if n != "zones"}
                entries = one.column("zones").flatten()
                low, high = _matrix(entries.field("low")), _matrix(entries.field("high"))
                anchors = _unpacked(row["vectors"], len(row["keys"]), row["size"])
                up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
                least = products(up, low) + products(down, high)
                most = products(up, high) + products(down, low)
                need = needed(row, least, most)
                some = np.flatnonzero(need.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(some), pa.int64()),
                        entries.field("block").take(pa.array(some)),
                        pa.array([np.flatnonzero(need[:, b]) for b in some], pa.list_(pa.int32())),
                    ],
                    names=["chunk", "block", "need"],
                )

    joined = chunks.join(sized(paged), ["size", "page"])
    return joined.mapInArrow(run, "chunk bigint, block bigint, need array<int>")


def _score(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, pick: Callable, kind: str) -> DataFrame:
    """What ``pick(row, need, scores, keys, labels, places)`` finds in each pair of a chunk and a block.

    Pairs carry numbers only; anchors and candidates reach them by two joins, one after the other,
    so a block is shuffled once and not once per anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                whole = lambda n: one.column(n).flatten().to_numpy(zero_copy_only=False)
                row = {
                    n: one.column(n)[0].as_py()
                    for n in one.schema.names
                    if n not in ("c_keys", "c_labels", "c_places", "c_vectors")
                }
                size = row["size"]
                rows = len(one.column("c_keys")[0])
                candidates = _unpacked(one.column("c_vectors")[0].as_buffer(), rows, size)
                anchors = _unpacked(row["vectors"], len(row["keys"]), size)
                need = np.asarray(row["need"])
                scores = products(anchors[need], candidates)
                found = pick(row, need, scores, whole("c_keys"), whole("c_labels"), whole("c_places"))
                if found is not None:
                    yield found

    candidates = blocks.select("block", *[F.col(n).alias(f"c_{n}") for n in ("keys", "labels", "places", "vectors")])
    parts = shuffle_partitions(pairs.sparkSession)
    dealt = pairs.repartition(parts, "chunk", "block")
    return dealt.join(chunks, "chunk").join(candidates, "block").mapInArrow(run, kind)


def _best(mask: np.ndarray, scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best scores under the mask of one row; equal scores by key."""
    at = np.flatnonzero(mask)
    if len(at) > k:
        cut = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= cut]
    return at[np.lexsort((keys[at], -scores[at]))][:k]


POSITIVE = "anchor bigint, chunk bigint, position int, anchor_id bigint, positive_id bigint, place bigint, score bigint"
NEGATIVE = "chunk bigint, position int, positive_score bigint, negative_id bigint, place bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame, anchors: Column | None = None, key: str = "vec_id", vector: str = "embedding",
    label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of whole-number vectors (see :func:`quantised`). For each row that ``anchors``
    selects (by default keys divisible by 50) and each of its first ``positives`` other rows of its
    label come the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``: higher scores first, ties by
    smaller key, null keys last. Rows with a null label or vector, or a null or non-finite component, take no
    part; a row with a null key is no anchor. Only vectors of one size meet; empty ones score 0. Rows that
    repeat a key are rows of their own. A score past 64 bits stops the job. Further columns are ignored.

    Candidates are stored in blocks of neighbours on a Hilbert curve, each with the least and largest value
    of every dimension. Interval arithmetic on these bounds every score in a block, for a chunk of anchors and
    a page of zone maps in one product. An anchor's own block gives it a first fifth-best score: for
    positives it reads the blocks that can reach that, for negatives those that can meet a window of its
    positives. Vectors without structure, in many dimensions, are bounded badly and most blocks are
    read: the work is then anchors times rows, in blocks.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("key"),
        F.col(label).cast("long").alias("label"),
        quantised(F.col(vector)).alias("vector"),
        F.coalesce(F.col(key) % 50 == 0 if anchors is None else anchors, F.lit(False)).alias("is_anchor"),
    )
    rows = rows.withColumn("size", F.size("vector")).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(_place(rows), "places")
    blocks = _blocks(placed, BLOCK_ROWS, "blocks")
    chunks = _blocks(placed.where("is_anchor AND key IS NOT NULL"), CHUNK_ROWS, "anchors")
    chunks = chunks.withColumnRenamed("block", "chunk")
    zones = blocks.select("block", "size", "low", "high")

    def first(row, need, scores, keys, labels, places) -> pa.RecordBatch | None:
        out = [[] for _ in range(7)]
        for n, line in zip(need.tolist(), scores):
            own = row["places"][n]
            at = _best((labels == row["labels"][n]) & (places != own), line, keys, positives)
            columns = ([own] * len(at), [row["chunk"]] * len(at), [n] * len(at), [row["keys"][n]] * len(at),
                       keys[at], places[at], line[at])
            for held, part in zip(out, columns):
                held.extend(part)
        names = ["anchor", "chunk", "position", "anchor_id", "positive_id", "place", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def best_positives(pairs: DataFrame, name: str) -> DataFrame:
        scored = _score(pairs, chunks, blocks, first, POSITIVE)
        order = [F.desc("score"), F.asc("positive_id"), F.asc("place")]
        return materialise(top_k(scored, positives, order, ["chunk", "position"]), name)

    # each anchor's own block gives a score that its positives reach
    home = blocks.select("block", F.explode("places").alias("place"))
    member = chunks.select("chunk", F.posexplode("places").alias("position", "place"))
    home = member.join(home, "place").groupBy("chunk", "block").agg(F.collect_list("position").alias("need"))
    near = best_positives(materialise(home, "own_blocks"), "near_positives")
    floors = near.where(F.col("rank") == positives).groupBy("chunk").agg(
        F.collect_list(F.struct("position", "score")).alias("floors")
    )

    def reaches(row, least, most) -> np.ndarray:
        floor = np.full(len(most), np.iinfo(np.int64).min)
        for entry in row["floors"] or ():
            floor[entry["position"]] = entry["score"]
        return most >= floor[:, None]

    pairs = _read_zones(chunks.select("chunk", "size", "keys", "vectors").join(floors, "chunk", "left"), zones, reaches)
    found = best_positives(materialise(pairs, "positive_blocks"), "positives")
    windows = found.groupBy("chunk").agg(
        F.array_distinct(F.collect_list(F.struct("position", "score"))).alias("windows")
    )
    windows = materialise(windows, "windows")

    def meets(row, least, most) -> np.ndarray:
        need = np.zeros(most.shape, bool)
        for entry in row["windows"]:
            n, score = entry["position"], entry["score"]
            need[n] |= (-(-low * score // 100) <= most[n]) & (least[n] <= high * score // 100)
        return need

    def window(row, need, scores, keys, labels, places) -> pa.RecordBatch | None:
        line_of = {n: i for i, n in enumerate(need.tolist())}
        out = [[] for _ in range(6)]
        for entry in row["windows"]:
            n, score = entry["position"], entry["score"]
            if n not in line_of:
                continue
            line = scores[line_of[n]]
            inside = (line >= -(-low * score // 100)) & (line <= high * score // 100)
            at = _best(inside & (labels != row["labels"][n]), line, keys, negatives)
            columns = ([row["chunk"]] * len(at), [n] * len(at), [score] * len(at), keys[at], places[at], line[at])
            for held, part in zip(out, columns):
                held.extend(part)
        names = ["chunk", "position", "positive_score", "negative_id", "place", "negative_score"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    wanted = chunks.select("chunk", "size", "keys", "vectors").join(windows, "chunk")
    pairs = materialise(_read_zones(wanted, zones, meets), "negative_blocks")
    scored = _score(pairs, chunks.join(windows, "chunk"), blocks, window, NEGATIVE)
    order = [F.desc("negative_score"), F.asc("negative_id"), F.asc("place")]
    best = top_k(scored, negatives, order, ["chunk", "position", "positive_score"]).drop("place")
    asked = found.select("chunk", "position", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c)).alias(c)
    return asked.join(best, ["chunk", "position", "positive_score"]).select(
        "anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"
    )
