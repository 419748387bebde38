"""Models over the whole vocabulary, held against SQL that solves the same problem another way."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textassay.catalog.base import ngrams_sql, query, split_labelled, table, terms_sql, texts
from textassay.catalog.features import TERMS, TFIDF, split_terms
from textassay.catalog.models import input_state
from textassay.operators import blocks, metrics, profiles, selection, tfidf
from textassay.operators.neighbours import nearest_neighbours
from textassay.plans import classifiers, evaluation, layout, projection, regression, svd
from textassay.plans.features import selected_vectors
from textassay.session import app_dir, discard, materialise

TOLERANCE = 1e-8  # of the gradient, tight enough to compare four decimals


def term_regression(spark, sf_dir):
    """Vectoriser and regression over all terms of the training split, kept per application and state of the tables."""
    docs = materialise(split_terms(spark, sf_dir), "document_terms")
    train = docs.where("split = 'train'")
    vectoriser = tfidf.fit_tfidf(train)
    config = {"model": "term_regression", "c": 1.0, "tol": TOLERANCE, "data": input_state(spark, sf_dir)}
    path = classifiers.model_path(f"{app_dir(spark)}/models", config)
    model = regression.load_regression(spark, path)
    if model is None:
        entries = materialise(tfidf.transform_tfidf(train, vectoriser), "train_terms")
        matrix = blocks.block_matrix(entries, train.select("doc_id", "label"))
        regression.save_regression(regression.fit_term_regression(matrix, tol=TOLERANCE), path)
        model = regression.load_regression(spark, path)
    return docs, vectoriser, model


# The regression's dual: a document's margin is a sum over the training documents, weighted by their residuals.
# Residuals are a fixed point, found by damped steps; the damping is bounded by the largest row sum of the products.
DUAL = f"""{TFIDF},
train AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) AS at FROM split WHERE split = 'train'),
near AS (
  SELECT a.doc_id, b.doc_id AS other, sum(a.tfidf * b.tfidf) AS k
  FROM tfidf a JOIN tfidf b ON a.term = b.term AND b.split = 'train' GROUP BY a.doc_id, b.doc_id),
products AS (
  SELECT s.doc_id, s.split, s.label, list(coalesce(n.k, 0.0) ORDER BY t.at) AS k
  FROM split s CROSS JOIN train t LEFT JOIN near n ON n.doc_id = s.doc_id AND n.other = t.doc_id
  GROUP BY s.doc_id, s.split, s.label),
problem AS (
  SELECT list(p.k ORDER BY t.at) AS k, list(CAST(t.label AS DOUBLE) ORDER BY t.at) AS y, count(*) AS n,
    1 / (1 + max(list_sum(p.k)) / 4) AS rate
  FROM train t JOIN products p ON p.doc_id = t.doc_id),
fit AS (
  SELECT 0 AS step, list_transform(y, lambda x: CAST(0 AS DOUBLE)) AS a, CAST(0 AS DOUBLE) AS b FROM problem
  UNION ALL
  SELECT step + 1, list_transform(r, lambda x, i: a[i] + rate * (x - a[i])), b + list_sum(r) / n
  FROM (
    SELECT step, a, b, n, rate,
      list_transform(k, lambda row, i: y[i] - 1 / (1 + exp(-list_inner_product(row, a) - b))) AS r
    FROM fit, problem WHERE step < 1500)),
solved AS (SELECT a, b FROM fit WHERE step = 1500)"""


@query(
    "term_regression_scores",
    f"""WITH RECURSIVE {DUAL}, margins AS (
  SELECT doc_id, split, label, list_inner_product(k, a) + b AS m FROM products, solved)
SELECT doc_id, split, label, round(1 / (1 + exp(-m)), 4) AS prob, CAST(m > 0 AS INTEGER) AS prediction FROM margins""",
)
def term_regression_scores(spark, sf_dir):
    """Class and probability of every labelled document by the regression over all 1- to 3-grams."""
    docs, vectoriser, model = term_regression(spark, sf_dir)
    scored = regression.classify(docs, vectoriser, model, ("split", "label"))
    return scored.withColumn("prob", F.round("prob", 4))


@query(
    "term_coefficients",
    f"""WITH RECURSIVE {DUAL}, weights AS (
  SELECT f.term, sum(f.tfidf * s.a[t.at]) AS w, count(*) AS df
  FROM tfidf f JOIN train t USING (doc_id), solved s GROUP BY f.term),
placed AS (
  SELECT term, df, w, row_number() OVER (ORDER BY round(abs(w), 5) DESC, term) AS place FROM weights)
SELECT CAST(place AS INTEGER) AS place, term, df, round(w, 4) AS weight FROM placed WHERE place <= 50""",
)
def term_coefficients(spark, sf_dir):
    """The 50 terms of largest weight, a report."""
    _, _, model = term_regression(spark, sf_dir)
    strongest = model.coefficients.withColumn("_size", F.round(F.abs("weight"), 5))
    top = strongest.orderBy(F.desc("_size"), F.asc("term")).limit(50)
    places = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("s"), "term", "df", "weight"))).alias("e"))
    return places.select(F.posexplode("e").alias("place", "e")).select(
        (F.col("place") + 1).alias("place"), "e.term", "e.df", F.round("e.weight", 4).alias("weight")
    )


@query("term_regression_history")
def term_regression_history(spark, sf_dir):
    """Objective and gradient norm after each iteration."""
    _, _, model = term_regression(spark, sf_dir)
    return spark.createDataFrame(model.history, "iteration int, objective double, gradient_norm double")


def unit_terms_sql(name: str, key: str, text: str = "coalesce(text, '')") -> str:
    return f"""tokens AS (SELECT {key} AS doc_id, {terms_sql(text)} AS w FROM {name}),
tf AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({ngrams_sql("w")}) AS term FROM tokens) GROUP BY doc_id, term),
vocabulary AS (
  SELECT term, ln((1 + (SELECT count(*) FROM {name})) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM tf GROUP BY term),
weighted AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocabulary USING (term)),
tfidf AS MATERIALIZED (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted)"""


def unit_terms(docs, key: str = "doc_id"):
    """TF-IDF entries of a table of texts, fitted on all of them, and its keys."""
    terms = materialise(tfidf.document_terms(docs.withColumn("text", F.coalesce("text", F.lit("")))), "document_terms")
    model = tfidf.fit_tfidf(terms)
    entries = materialise(tfidf.transform_tfidf(terms, model, key), "unit_terms")
    discard(model.vocabulary)
    return entries, terms.select(key)


def power_sql(rounds: int) -> str:
    """Power iteration on the product of the documents' matrix with its transpose."""
    steps = ["v0 AS (SELECT DISTINCT doc_id, 1.0 AS x FROM tfidf)"]
    for i in range(rounds):
        steps += [
            f"u{i} AS (SELECT term, sum(w * x) AS x FROM tfidf JOIN v{i} USING (doc_id) GROUP BY term)",
            f"s{i} AS (SELECT doc_id, sum(w * x) AS x FROM tfidf JOIN u{i} USING (term) GROUP BY doc_id)",
            f"v{i + 1} AS (SELECT doc_id, x / sqrt(sum(x * x) OVER ()) AS x, sqrt(sum(x * x) OVER ()) AS value FROM s{i})",
        ]
    return ",\n".join(steps)


@query(
    "first_singular_value",
    f"""WITH {unit_terms_sql("documents", "doc_id")}, {power_sql(30)}
SELECT round(sqrt(max(value)), 4) AS value FROM v30""",
)
def first_singular_value(spark, sf_dir):
    """The first of a hundred singular values of all documents over all their terms."""
    entries, keys = unit_terms(texts(spark, sf_dir, "documents", "doc_id", "text"))
    found = svd.term_svd(entries, keys, spent=True)
    return spark.createDataFrame([(round(found.values[0], 4),)], "value double")


@query("singular_coordinates")
def singular_coordinates(spark, sf_dir):
    """Every document in the first hundred singular directions over all terms."""
    entries, keys = unit_terms(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return svd.term_svd(entries, keys, spent=True).coordinates


def document_neighbours(spark, sf_dir):
    """Every document in fifty singular directions over all terms, and its nearest others there."""
    entries, keys = unit_terms(texts(spark, sf_dir, "documents", "doc_id", "text"))
    coordinates = svd.term_svd(entries, keys, k=50, passes=2, spent=True).coordinates
    return coordinates, nearest_neighbours(coordinates, "doc_id", "coordinates")


def plane_of_documents(spark, sf_dir):
    """The documents in a plane that keeps neighbours, laid out once per application and state of the tables."""
    config = {"model": "neighbour_plane", "k": 50, "data": input_state(spark, sf_dir)}
    path = classifiers.model_path(f"{app_dir(spark)}/models", config)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        coordinates, near = document_neighbours(spark, sf_dir)
        layout.neighbour_plane(near, projection.plane(coordinates)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("document_neighbours")
def neighbours_of_documents(spark, sf_dir):
    """The fifteen nearest other documents of every document, by distance in the singular directions."""
    return document_neighbours(spark, sf_dir)[1]


@query("neighbour_plane")
def neighbour_plane(spark, sf_dir):
    """Every document in a plane that keeps its neighbours."""
    return plane_of_documents(spark, sf_dir)


@query("plane_density")
def plane_density(spark, sf_dir):
    """Smoothed density of each label's documents in that plane, clipped to its bounds."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    placed = materialise(plane_of_documents(spark, sf_dir).join(labels, "doc_id"), "placed")
    return profiles.density_surface(placed)


@query(
    "similar_passages",
    f"""WITH {unit_terms_sql("benchmark", "item_id")}, first AS (SELECT min(item_id) AS id FROM benchmark),
norms AS (SELECT doc_id, sum(w * w) AS squared FROM tfidf GROUP BY doc_id),
near AS (
  SELECT a.doc_id, sum(a.w * b.w) AS cosine
  FROM tfidf a JOIN tfidf b ON a.term = b.term JOIN first f ON b.doc_id = f.id GROUP BY a.doc_id)
SELECT item_id, round(coalesce(squared, 0), 6) AS squared, round(coalesce(cosine, 0), 6) AS cosine
FROM benchmark LEFT JOIN norms n ON n.doc_id = item_id LEFT JOIN near c ON c.doc_id = item_id""",
)
def similar_passages(spark, sf_dir):
    """Squared norm of every passage, and its cosine with the first one, both from up to 500 singular coordinates."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    entries, keys = unit_terms(items)
    found = svd.term_svd(entries, keys, k=500, spent=True).coordinates
    first = found.orderBy("doc_id").limit(1).select(F.col("coordinates").alias("_first"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    beside = found.withColumn("_first", first.scalar())
    return beside.select(
        F.col("doc_id").alias("item_id"),
        (F.round(product("coordinates", "coordinates"), 6) + 0.0).alias("squared"),
        (F.round(product("coordinates", "_first"), 6) + 0.0).alias("cosine"),
    )


CHI_SQUARED = f"""{TERMS},
sizes AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
    CAST(count(*) AS DOUBLE) AS n FROM split WHERE split = 'train'),
found AS (
  SELECT term, count(*) AS df, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1
  FROM tf WHERE split = 'train' GROUP BY term),
chi_squared AS (
  SELECT term, df, CASE WHEN df = n THEN 0 ELSE
    n * (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 / (df * (n - df) * n0 * n1) END AS chi2 FROM found, sizes)"""


def chi_squared(spark, sf_dir):
    docs = materialise(split_terms(spark, sf_dir), "document_terms")
    return docs, materialise(selection.chi_squared(docs.where("split = 'train'")), "chi_squared")


@query("chi_squared_terms", f"WITH {CHI_SQUARED} SELECT term, df, round(chi2, 6) AS chi2 FROM chi_squared")
def chi_squared_terms(spark, sf_dir):
    """Every training term's chi-squared against the label."""
    return chi_squared(spark, sf_dir)[1].withColumn("chi2", F.round("chi2", 6))


@query(
    "selected_terms",
    f"""WITH {CHI_SQUARED} SELECT term, df, round(chi2, 6) AS chi2 FROM chi_squared
ORDER BY round(chi2, 9) DESC, df DESC, term LIMIT 1000""",
)
def selected_terms(spark, sf_dir):
    """The thousand terms that tell the classes apart best."""
    return selection.select_terms(chi_squared(spark, sf_dir)[1]).withColumn("chi2", F.round("chi2", 6))


def term_forest(spark, sf_dir):
    """Names of the selected terms, vectors of all labelled rows, and the forest grown on the training rows."""
    docs, scored = chi_squared(spark, sf_dir)
    vectoriser = tfidf.fit_tfidf(docs.where("split = 'train'"))
    selected = selection.select_terms(scored)
    names, rows = selected_vectors(docs, vectoriser, selected, ("doc_id", "split", "label"))
    rows = materialise(rows, "selected_vectors")
    train = rows.where("split = 'train'")
    train = classifiers.tree_rows(train, train.count(), len(names))
    return names, rows, classifiers.random_forest().fit(train)


@query("term_forest_importance")
def term_forest_importance(spark, sf_dir):
    """The terms that a forest over selected terms uses most."""
    names, _, forest = term_forest(spark, sf_dir)
    return classifiers.term_importance(forest, names, spark)


@query("term_forest_evaluation")
def term_forest_evaluation(spark, sf_dir):
    """The forest over selected terms on the test rows."""
    _, rows, forest = term_forest(spark, sf_dir)
    return metrics.classification_report(evaluation.score(forest, rows.where("split = 'test'")))


@query(
    "selected_vectors",
    f"""WITH {TFIDF}, {CHI_SQUARED[len(TERMS) + 1:]}, chosen AS (
  SELECT term FROM chi_squared ORDER BY round(chi2, 9) DESC, df DESC, term LIMIT 1000)
SELECT doc_id, split, label, term, round(tfidf, 6) AS value FROM tfidf WHERE term IN (FROM chosen)""",
)
def selected_vector_rows(spark, sf_dir):
    """What the forest reads: the selected terms' entries, one row per document and term."""
    docs, scored = chi_squared(spark, sf_dir)
    vectoriser = tfidf.fit_tfidf(docs.where("split = 'train'"))
    keep = ("doc_id", "split", "label")
    names, rows = selected_vectors(docs, vectoriser, selection.select_terms(scored), keep)
    table = spark.createDataFrame(list(enumerate(names)), "at int, term string")
    entries = rows.select(*keep, F.posexplode(vector_to_array("features")).alias("at", "value")).where("value <> 0")
    return entries.join(F.broadcast(table), "at").select(*keep, "term", F.round("value", 6).alias("value"))
