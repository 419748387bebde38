"""Order-dependent operators without a single-task window.

``tag_order`` range-sorts the rows, which Spark balances by sampling whatever
the key distribution, and writes them with the number of the range they fell
into. Global positions and running totals are then two small steps: an offset
per range (as many rows as there are ranges) and a window inside each range.
The ranges are stored, so a lost executor cannot change their boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def tag_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` sorted by a unique ``order``, stored, with ``_part`` and ``_row``."""
    at = F.monotonically_increasing_id()
    stored = materialise(df.orderBy(*order).withColumn("_at", at), "ordered")
    return stored.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).cast("int").alias("_part"),
        F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )


def ordered_index(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Add the global position in ``order`` as column ``name``, from ``start``."""
    tagged = tag_order(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        tagged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        "offsets",
    )
    return tagged.join(offsets, "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + start).alias(name)
    )


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """For each ``s`` in ``sums`` add ``cum_s`` (inclusive) and ``total_s``.

    Totals run in ``order`` within ``groups``; ``order`` must be unique there.
    """
    groups = list(groups)
    tagged = tag_order(df, [*map(F.col, groups), *order])
    parts = tagged.groupBy(*groups, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = materialise(
        parts.select(
            *groups,
            "_part",
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
        ),
        "offsets",
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("_row")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select(
        *df.columns, "_part", *[F.sum(s).over(upto).alias(f"_inside_{s}") for s in sums]
    )
    return local.join(offsets, [*groups, "_part"]).select(
        *df.columns,
        *[(F.col(f"_before_{s}") + F.col(f"_inside_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )


def quantiles(
    df: DataFrame, value: str, points: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``points``.

    Equal values are counted before anything is ordered; no task ever holds all
    distinct values, unlike the built-in exact ``percentile``.
    """
    groups = list(groups)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counted, [F.col(value)], ["n"], groups)
    aggregates = []
    for name, q in points.items():
        position = (F.col("total_n") - 1) * F.lit(float(q))
        for side, place in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("cum_n") - F.col("n") <= place) & (place < F.col("cum_n"))
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        fraction = position - F.floor(position)
        aggregates.append(F.max(fraction).alias(f"_{name}_f"))
    picked = ranked.groupBy(*groups).agg(*aggregates)
    return picked.select(
        *groups,
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_f")
            ).alias(name)
            for name in points
        ],
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column], groups: Sequence[str]) -> DataFrame:
    """First ``k`` rows per group with their ``rank``.

    Spark plans ``row_number() <= k`` as a group limit that runs before the
    shuffle, so each task sends at most ``k`` rows per group however large the
    group is.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def shuffled(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Repeatable random order: by the seeded hash of the key."""
    from textassay.operators.splits import hash_of

    return df.orderBy(hash_of(key, seed), key)
