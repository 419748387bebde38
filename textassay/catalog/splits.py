"""Splits, samples, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textassay.catalog.base import LABELLED, SPLIT, labelled, query, table
from textassay.operators import ordered, setops, splits


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, label, split FROM split")
def stratified_split(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "label")
    return splits.stratified_split(rows)


RANKED = f"""{LABELLED}, ranked AS (
  SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS rn
  FROM labelled)"""


@query(
    "holdout_split",
    f"""WITH {RANKED} SELECT doc_id, label,
  CASE WHEN rn <= n // 5 THEN 'train' ELSE 'val' END AS split FROM ranked""",
)
def holdout_split(spark, sf_dir):
    return splits.holdout_split(labelled(spark, sf_dir).select("doc_id", "label"))


@query(
    "balanced_sample",
    f"""WITH {RANKED}, smallest AS (SELECT least(4000, min(n)) AS k FROM ranked)
SELECT doc_id, label FROM ranked, smallest WHERE rn <= k""",
)
def balanced_sample(spark, sf_dir):
    return splits.balanced_sample(labelled(spark, sf_dir).select("doc_id", "label"))


FOLDS = f"""{RANKED}, folds AS (
  SELECT doc_id, label,
    CAST(CAST('0x' || substr(md5(concat(doc_id, ':42:fold')), 1, 8) AS BIGINT) % 5 AS INTEGER)
      AS fold,
    CAST((SELECT min(j) FROM range(1, 11) t(j) WHERE rn <= n * j // 10) AS INTEGER) AS step
  FROM ranked)"""


@query("learning_folds", f"WITH {FOLDS} SELECT doc_id, label, fold, step FROM folds")
def learning_folds(spark, sf_dir):
    return splits.folds(labelled(spark, sf_dir).select("doc_id", "label"))


@query(
    "shuffled_labels",
    "SELECT doc_id, quality, row_number() OVER (ORDER BY md5(concat(doc_id, ':42')), doc_id) "
    "- 1 AS position FROM labels",
)
def shuffled_labels(spark, sf_dir):
    """The shuffled order as a column, since a result set has no order to compare."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    order = [splits.hash_of("doc_id", 42), F.col("doc_id")]
    return ordered.ordered_index(rows, order, "position")


@query(
    "merged_sources",
    """SELECT doc_id, 1 AS label FROM documents WHERE source < 'src2'
UNION ALL SELECT doc_id, 0 AS label FROM documents WHERE source >= 'src2' OR source IS NULL""",
)
def merged_sources(spark, sf_dir):
    """All documents, as two groups of sources."""
    docs = table(spark, sf_dir, "documents")
    return setops.merge_labelled(
        docs.where("source < 'src2'").select("doc_id"),
        docs.where("source >= 'src2' OR source IS NULL").select("doc_id"),
    )


@query(
    "exact_duplicates_dropped",
    f"WITH {LABELLED} SELECT DISTINCT text, label FROM labelled",
)
def exact_duplicates_dropped(spark, sf_dir):
    return setops.drop_exact_duplicates(labelled(spark, sf_dir))
