"""Repeatable stratified splits, balanced samples and folds.

Rows are ranked by a seeded hash of their key inside each stratum. The exact
rank cuts are found without ranking the rows: count per hash bucket, find the
bucket a cut falls into, rank only that bucket. A stratum may hold any share of
the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.session import materialise

SPLITS = ("train", "val", "test")


def hash_of(key: str = "doc_id", seed: int = 42, tag: str = "") -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}{tag}")))


def share(n: Column, ratio: float) -> Column:
    """``floor(n * ratio)`` in exact integer arithmetic."""
    r = Fraction(str(ratio))
    return F.call_function("div", n * F.lit(r.numerator), F.lit(r.denominator))


def stored_keys(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """Key and stratum of every row, stored: the passes that look for the cuts
    read these two narrow columns and not the text behind them again."""
    return materialise(df.select(stratum, key), "keys")


def hash_cuts(
    keys: DataFrame,
    stratum: str,
    ranks: Callable[[Column], Sequence[Column]],
    key: str = "doc_id",
    seed: int = 42,
    bucket_chars: int = 4,
) -> DataFrame:
    """Per stratum, the hash and key of the row at each rank in ``ranks(n)``.

    One row per stratum with a map ``cuts`` from the number of the cut to its
    ``(hash, key)``; a rank of 0, or past the last row, has no entry.
    ``bucket_chars`` hex digits of the hash make a bucket, 16 ** bucket_chars
    buckets per stratum. ``keys`` (see :func:`stored_keys`) is read twice.
    """
    rows = keys.select(stratum, F.col(key).alias("_key"), hash_of(key, seed).alias("_hash"))
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, bucket_chars))
    per_bucket = rows.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(stratum).orderBy("_bucket")
    wanted = F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("_total"))]))
    located = (
        per_bucket.withColumn("_upto", F.sum("_n").over(w))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(stratum)))
        .select(stratum, "_bucket", "_n", "_upto", wanted.alias("_cut", "_rank"))
        .where(
            (F.col("_rank") > F.col("_upto") - F.col("_n"))
            & (F.col("_rank") <= F.col("_upto"))
        )
        .select(
            stratum,
            "_bucket",
            "_cut",
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_place"),
        )
    )
    # one row per cut and stratum: small by construction, stored so that
    # Catalyst sees its size before it joins it to the rows
    located = materialise(located, "cut_buckets")
    inside = Window.partitionBy(stratum, "_bucket").orderBy("_hash", "_key")
    edge = rows.join(
        located.select(stratum, "_bucket").distinct(), [stratum, "_bucket"], "left_semi"
    ).withColumn("_place", F.row_number().over(inside))
    found = edge.join(located, [stratum, "_bucket", "_place"]).groupBy(stratum).agg(
        F.map_from_entries(
            F.collect_list(F.struct("_cut", F.struct("_hash", "_key")))
        ).alias("cuts")
    )
    return materialise(found, "cuts")


def with_cut_number(
    df: DataFrame,
    cuts: DataFrame,
    stratum: str,
    n_cuts: int,
    name: str,
    key: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """Add the 0-based number of the first cut at or after the row (else ``n_cuts``)."""
    at = F.struct(hash_of(key, seed), F.col(key))
    number = F.lit(n_cuts)
    for i in reversed(range(n_cuts)):
        number = F.when(at <= F.col("_cuts")[i], F.lit(i)).otherwise(number)
    joined = df.join(cuts.withColumnRenamed("cuts", "_cuts"), stratum, "left")
    return joined.withColumn(name, number).drop("_cuts").select(*df.columns, name)


def stratified_split(
    df: DataFrame,
    stratum: str = "label",
    key: str = "doc_id",
    seed: int = 42,
    ratios: Sequence[float] = (0.70, 0.15, 0.15),
    names: Sequence[str] = SPLITS,
) -> DataFrame:
    """Add ``split``; the shares hold inside every stratum."""
    bounds, upto = [], Fraction(0)
    for r in ratios[:-1]:
        upto += Fraction(str(r))
        bounds.append(float(upto))
    keys = stored_keys(df, stratum, key)
    cuts = hash_cuts(keys, stratum, lambda n: [share(n, b) for b in bounds], key, seed)
    numbered = with_cut_number(df, cuts, stratum, len(bounds), "_no", key, seed)
    split = F.lit(names[-1])
    for i in reversed(range(len(bounds))):
        split = F.when(F.col("_no") == i, F.lit(names[i])).otherwise(split)
    return numbered.withColumn("split", split).drop("_no")


def holdout_split(df: DataFrame, train_size: float = 0.20, **kwargs) -> DataFrame:
    """Stratified two-way split into ``train`` and ``val``."""
    rest = float(1 - Fraction(str(train_size)))
    return stratified_split(df, ratios=(train_size, rest), names=("train", "val"), **kwargs)


def balanced_sample(
    df: DataFrame,
    sample_size: int = 8000,
    stratum: str = "label",
    key: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """The same number of rows of every class: half the size or the smallest class."""
    keys = stored_keys(df, stratum, key)
    smallest = keys.groupBy(stratum).count().agg(F.min("count")).first()[0] or 0
    take = min(sample_size // 2, smallest)
    cuts = hash_cuts(keys, stratum, lambda n: [F.lit(take)], key, seed)
    numbered = with_cut_number(df, cuts, stratum, 1, "_no", key, seed)
    return numbered.where(F.col("_no") == 0).drop("_no")


def folds(
    df: DataFrame,
    n_folds: int = 5,
    n_sizes: int = 10,
    stratum: str = "label",
    key: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``fold`` (0-based) and ``step`` (1-based) for learning curves.

    Fold ``f`` validates on ``fold = f``. Its training set of size ``j/n_sizes``
    is ``fold <> f and step <= j``: nested prefixes of the hash order of each
    stratum. Both are columns, so no row is copied per fold or size.
    """
    cuts = hash_cuts(
        stored_keys(df, stratum, key),
        stratum,
        lambda n: [F.call_function("div", n * j, F.lit(n_sizes)) for j in range(1, n_sizes)],
        key,
        seed,
    )
    stepped = with_cut_number(df, cuts, stratum, n_sizes - 1, "_no", key, seed)
    digits = F.substring(hash_of(key, seed, ":fold"), 1, 8)
    fold = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n_folds)).cast("int")
    return stepped.withColumn("fold", fold).withColumn("step", F.col("_no") + 1).drop("_no")
