"""Line dedup by frequency within a site, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.operators.joins import hot_keys, lookup_join
from textassay.session import materialise

RATIO = 0.05
MIN_PAGES = 2  # a line of one page repeats nowhere; from there on the ratio decides


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def _id(line: Column) -> Column:
    """Two hashes: 96 bits, compared within one host only."""
    octets = F.crc32(line.cast("binary")).cast("string")
    return F.concat(F.lit("["), F.xxhash64(line).cast("string"), F.lit(":"), octets, F.lit("]"))


def _host(host: str) -> Column:
    """A host, or the one unnamed host that rows without one belong to."""
    return F.when(F.col(host).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(host).cast("string")))


def boilerplate_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``(_host, _ids)``: ids, one after the other, of the lines of each host that over ``ratio`` of its pages contain.

    A line counts once per page however often it stands there, and only if at least
    ``min_pages`` pages have it, so a host of one page loses nothing. Counts are combined before the shuffle by host and
    line, so no host meets in one task. A host has fewer such lines than the average page has
    lines, divided by ``ratio``.
    """
    pages = docs.select(_host(host).alias("_host"), F.col(text).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count("*").alias("pages"))
    distinct = F.array_distinct(
        F.transform(F.filter(_lines(F.col("_text")), lambda x: ~_is_blank(x)), _id)
    )
    counts = (
        pages.select("_host", F.explode(distinct).alias("_id"))
        .groupBy("_host", "_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    frequent = counts.join(totals, "_host").where(F.col("n") > ratio * F.col("pages"))
    return materialise(
        frequent.groupBy("_host").agg(F.array_join(F.collect_list("_id"), "").alias("_ids")),
        "boilerplate",
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    spread_on: str = "doc_id",
) -> DataFrame:
    """``docs`` without its hosts' boilerplate lines; adds ``n_lines`` and ``n_dropped``.

    Lines end at a line feed; blank lines are neither counted nor dropped, and count
    in ``n_lines``. A null text stays null with 0 lines, an empty one has one blank line. Rows
    without a host form one host. Repeated rows are pages of their own. Columns
    named like the added ones are replaced. Hosts too frequent for one task are
    spread over salts by ``spread_on`` unless the lines found are small enough to
    be broadcast by their measured size.
    """
    base = docs.drop("n_lines", "n_dropped").withColumn("_host", _host(host))
    found = boilerplate_lines(docs, host, text, ratio, min_pages)
    weights = base.groupBy("_host").agg(F.count("*").alias("n"))
    hot = hot_keys(materialise(weights, "host_pages"), "_host", "n")
    joined = lookup_join(base, found, "_host", spread_on, "left", hot)
    lines = _lines(F.col(text))
    # where a host has no such line the text is left alone
    kept = F.filter(lines, lambda x: _is_blank(x) | ~F.contains(F.col("_ids"), _id(x)))
    return (
        joined.withColumn("_kept", F.when(F.col("_ids").isNotNull(), kept).otherwise(lines))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long"))
        .withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text)))
        .select(*base.drop("_host").columns, "n_lines", "n_dropped")
    )
