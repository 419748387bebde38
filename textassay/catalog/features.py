"""TF-IDF, vector normalisation and dense coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textassay.catalog.base import (
    POINTS,
    SPLIT,
    ngrams_sql,
    points,
    query,
    split_labelled,
    table,
    terms_sql,
)
from textassay.operators import profiles, tfidf
from textassay.session import materialise, scratch_path

TERMS = f"""{SPLIT}, tokens AS (SELECT doc_id, split, label, {terms_sql("text")} AS w FROM split),
grams AS (SELECT doc_id, split, label, {ngrams_sql("w")} AS g FROM tokens),
tf AS (
  SELECT doc_id, split, label, term, count(*) AS tf
  FROM (SELECT doc_id, split, label, unnest(g) AS term FROM grams)
  GROUP BY doc_id, split, label, term),
size AS (SELECT count(*) AS n FROM split WHERE split = 'train'),
vocabulary AS (
  SELECT term, df, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term), size)"""

TFIDF = f"""{TERMS}, weighted AS (
  SELECT t.doc_id, t.split, t.label, t.term, t.tf * v.idf AS w
  FROM tf t JOIN vocabulary v ON t.term = v.term),
tfidf AS (
  SELECT doc_id, split, label, term,
    w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM weighted)"""


def split_terms(spark, sf_dir):
    return tfidf.document_terms(split_labelled(spark, sf_dir))


def tfidf_features(spark, sf_dir):
    """``(doc_id, split, label, term, tfidf)`` fitted on the training split."""
    docs = materialise(split_terms(spark, sf_dir), "document_terms")
    model = tfidf.fit_tfidf(docs.where("split = 'train'"))
    return tfidf.transform_tfidf(docs, model, keep=("split", "label"))


@query(
    "document_frequencies",
    f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM vocabulary",
)
def document_frequencies(spark, sf_dir):
    # stored: the number of documents and their terms are two passes
    train = materialise(split_terms(spark, sf_dir).where("split = 'train'"), "document_terms")
    return tfidf.document_frequencies(train).withColumn("idf", F.round("idf", 6))


@query(
    "tfidf",
    f"WITH {TFIDF} SELECT doc_id, split, label, term, round(tfidf, 6) AS tfidf FROM tfidf",
)
def tfidf_rows(spark, sf_dir):
    return tfidf_features(spark, sf_dir).select(
        "doc_id", "split", "label", "term", F.round("tfidf", 6).alias("tfidf")
    )


@query(
    "saved_tfidf",
    f"WITH {TFIDF} SELECT doc_id, split, label, term, round(tfidf, 6) AS tfidf FROM tfidf WHERE split <> 'train'",
)
def saved_tfidf(spark, sf_dir):
    """Rows outside the training split, by a vectoriser that was saved and loaded again."""
    docs = materialise(split_terms(spark, sf_dir), "document_terms")
    path = scratch_path(spark, "vectoriser")
    tfidf.save_tfidf(tfidf.fit_tfidf(docs.where("split = 'train'")), path)
    rows = tfidf.transform_tfidf(docs.where("split <> 'train'"), tfidf.load_tfidf(spark, path), keep=("split", "label"))
    return rows.select("doc_id", "split", "label", "term", F.round("tfidf", 6).alias("tfidf"))


@query(
    "unit_embeddings",
    """WITH e AS (
  SELECT vec_id, unnest(embedding) AS x,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)
SELECT vec_id, pos, round(x / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY vec_id)), 6)
  AS x FROM e""",
)
def unit_embeddings(spark, sf_dir):
    rows = tfidf.l2_normalise(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


BOUNDS = f"""{POINTS}, both_axes AS (
  SELECT 'x' AS axis, x AS v FROM points UNION ALL SELECT 'y' AS axis, y AS v FROM points),
q AS (SELECT axis, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
  FROM both_axes GROUP BY axis),
bounds AS (SELECT axis, lo - (hi - lo) * 0.1 AS low, hi + (hi - lo) * 0.1 AS high FROM q)"""


@query(
    "axis_bounds",
    f"WITH {BOUNDS} SELECT axis, round(low, 6) AS low, round(high, 6) AS high FROM bounds",
)
def axis_bounds(spark, sf_dir):
    bounds = profiles.axis_bounds(points(spark, sf_dir))
    return bounds.select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "clipped_points",
    f"""WITH {BOUNDS} SELECT p.vec_id, p.label FROM points p
WHERE p.x BETWEEN (SELECT low FROM bounds WHERE axis = 'x') AND
                  (SELECT high FROM bounds WHERE axis = 'x')
  AND p.y BETWEEN (SELECT low FROM bounds WHERE axis = 'y') AND
                  (SELECT high FROM bounds WHERE axis = 'y')""",
)
def clipped_points(spark, sf_dir):
    return profiles.clip_to_bounds(points(spark, sf_dir)).select("vec_id", "label")


@query(
    "density_grid",
    f"""WITH {POINTS} SELECT label, CAST(floor(x / 0.05) AS BIGINT) AS x_cell,
  CAST(floor(y / 0.05) AS BIGINT) AS y_cell, count(*) AS n FROM points GROUP BY ALL""",
)
def density_grid(spark, sf_dir):
    return profiles.density_grid(points(spark, sf_dir))


def smoothed_sql(axis: str, source: str) -> str:
    """One axis of the Gaussian: offsets of up to 4 cells, deviation 1.5 cells."""
    other = {"x_cell": "y_cell", "y_cell": "x_cell"}[axis]
    return f"""SELECT label, {axis} + o AS {axis}, {other}, sum(w * k) AS w
  FROM {source}, kernel WHERE {axis} + o BETWEEN 0 AND 31 GROUP BY ALL"""


@query(
    "density_surface",
    f"""WITH {BOUNDS}, spans AS (
  SELECT max(low) FILTER (WHERE axis = 'x') AS xl, max(high) FILTER (WHERE axis = 'x') AS xh,
    max(low) FILTER (WHERE axis = 'y') AS yl, max(high) FILTER (WHERE axis = 'y') AS yh FROM bounds),
placed AS (
  SELECT label, (x - xl) / ((xh - xl) / 32) - 0.5 AS u, (y - yl) / ((yh - yl) / 32) - 0.5 AS v
  FROM points, spans WHERE x BETWEEN xl AND xh AND y BETWEEN yl AND yh),
corners AS (
  SELECT label, greatest(0, least(31, CAST(floor(u) AS INTEGER) + a)) AS x_cell,
    greatest(0, least(31, CAST(floor(v) AS INTEGER) + b)) AS y_cell,
    (CASE a WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END)
      * (CASE b WHEN 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END) AS w
  FROM placed, range(2) AS s(a), range(2) AS t(b)),
binned AS (SELECT label, x_cell, y_cell, sum(w) AS w FROM corners GROUP BY ALL),
offsets AS (SELECT unnest(range(-4, 5)) AS o),
kernel AS (SELECT CAST(o AS INTEGER) AS o, exp(-(o * o) / 4.5) / sum(exp(-(o * o) / 4.5)) OVER () AS k FROM offsets),
along AS ({smoothed_sql("x_cell", "binned")}),
smooth AS ({smoothed_sql("y_cell", "along")}),
shares AS (SELECT label, x_cell, y_cell, w / sum(w) OVER (PARTITION BY label) AS share FROM smooth)
SELECT label, CAST(x_cell AS INTEGER) AS x_cell, CAST(y_cell AS INTEGER) AS y_cell,
  round(share / ((xh - xl) * (yh - yl) / 1024), 5) AS density,
  round(sum(share) OVER (PARTITION BY label ORDER BY round(share, 9) DESC, x_cell, y_cell), 5) AS mass
FROM shares, spans""",
)
def density_surface(spark, sf_dir):
    """Smoothed density of each label's points, and the mass inside each contour."""
    found = profiles.density_surface(points(spark, sf_dir))
    return found.withColumns({"density": F.round("density", 5), "mass": F.round("mass", 5)})
