"""What SQL can state about the fitted models: which rows they saw, and properties that must hold.

Each query computes its properties from the real fit; the SQL beside it gives the rows,
the counts, and ``true`` for each property.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from textassay.catalog import models, streams
from textassay.catalog.base import LABELLED, SPLIT, labelled, query, split_labelled, table
from textassay.catalog.features import TERMS
from textassay.functions import posts as post_functions
from textassay.operators import curves
from textassay.operators.tfidf import l2_normalise
from textassay.plans import evaluation, projection
from textassay.plans.features import term_buckets
from textassay.session import materialise

N_CLUSTERS = 10
TOLERANCE = 1e-6


@query(
    "regression_scores_properties",
    f"""WITH {LABELLED} SELECT doc_id, label, true AS prob_in_range, true AS class_agrees
FROM labelled""",
)
def regression_scores(spark, sf_dir):
    """Each labelled document once, its probability in range and its class on that side of a half."""
    model, _ = models.fitted_regression(spark, sf_dir)
    scores = evaluation.score(model, labelled(spark, sf_dir))
    return scores.select(
        "doc_id",
        "label",
        F.col("prob").between(0, 1).alias("prob_in_range"),
        ((F.col("prob") > 0.5).cast("int") == F.col("prediction")).alias("class_agrees"),
    )


def split_support(scores):
    """Rows and classes of each split, and whether its measures are in range."""
    quality = curves.ranking_quality(curves.score_totals(scores, ["split"]), ["split"])
    support = scores.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.bool_and(F.col("prob").between(0, 1)).alias("prob_in_range"),
    )
    return support.join(F.broadcast(quality), "split").select(
        *support.columns, F.col("auc").between(0, 1).alias("auc_in_range")
    )


SUPPORT = f"""WITH {SPLIT} SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_positive,
  true AS prob_in_range, true AS auc_in_range FROM split WHERE %s GROUP BY split"""


@query("logistic_regression_properties", SUPPORT % "split <> 'train'")
def logistic_regression(spark, sf_dir):
    model, _ = models.fitted_regression(spark, sf_dir)
    keep = ("split", "label")
    return split_support(materialise(evaluation.score(model, models.held_out(spark, sf_dir), keep), "scores"))


@query("forest_evaluation_properties", SUPPORT % "split = 'test'")
def forest_evaluation(spark, sf_dir):
    test = models.held_out(spark, sf_dir).where("split = 'test'")
    forest = models.fitted_forest(spark, sf_dir)
    return split_support(materialise(evaluation.score(forest, test, ("split", "label")), "scores"))


@query(
    "training_history_properties",
    f"""WITH {SPLIT} SELECT count(*) AS n_train, true AS from_zero, true AS gapless, true AS never_rising
FROM split WHERE split = 'train'""",
)
def training_history(spark, sf_dir):
    """The objective after each iteration on the training rows."""
    rows = models.history(spark, sf_dir)
    falls = F.sort_array(F.collect_list(F.struct("iteration", "objective")))
    steps = rows.agg(  # one row per iteration, at most the iterations of the fit
        (F.min("iteration") == 0).alias("from_zero"),
        (F.max("iteration") - F.min("iteration") + 1 == F.count_distinct("iteration")).alias("gapless"),
        falls.alias("steps"),
    )
    rising = F.exists(
        F.zip_with(
            F.slice("steps", F.lit(1), F.size("steps") - 1),
            F.slice("steps", F.lit(2), F.size("steps") - 1),
            lambda a, b: b["objective"] > a["objective"],
        ),
        lambda x: x,
    )
    train = split_labelled(spark, sf_dir).where(models.IN_TRAIN)
    return train.agg(F.count("*").alias("n_train")).crossJoin(
        F.broadcast(steps.select("from_zero", "gapless", (~rising).alias("never_rising")))
    )


@query(
    "forest_importance_properties",
    f"""WITH {TERMS} SELECT count(DISTINCT g) AS n_terms, true AS sums_to_one, true AS never_negative,
  true AS terms_known FROM (SELECT unnest(g) AS g FROM grams WHERE split = 'train')""",
)
def forest_importance(spark, sf_dir):
    """All training terms, and the importances of the columns that they share."""
    forest = models.fitted_forest(spark, sf_dir).stages[-1]
    values = forest.featureImportances
    buckets = [(int(i), float(x)) for i, x in zip(values.indices, values.values, strict=True)]
    used = F.broadcast(spark.createDataFrame(buckets, "bucket long, importance double"))
    terms = materialise(term_buckets(split_labelled(spark, sf_dir).where(models.IN_TRAIN)), "terms")
    known = used.join(terms.select("bucket").distinct(), "bucket", "left_semi")
    held = known.agg(
        (F.abs(F.sum("importance") - 1) < TOLERANCE).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("never_negative"),
        (F.count("*") == F.lit(len(buckets))).alias("terms_known"),
    )
    return terms.agg(F.count("*").alias("n_terms")).crossJoin(F.broadcast(held))


@query(
    "cluster_quality_properties",
    "SELECT vec_id, label, true AS at_nearest, true AS cluster_in_range FROM embeddings",
)
def cluster_quality(spark, sf_dir):
    """Each vector, and whether its cluster is that of its nearest centre."""
    rows = projection.dense_features(l2_normalise(table(spark, sf_dir, "embeddings")))
    model = KMeans(k=N_CLUSTERS, seed=42).fit(rows)
    centres = [F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]

    def distance(centre):
        gaps = F.zip_with("embedding", centre, lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)

    away = model.transform(rows).withColumn("_away", F.array(*[distance(c) for c in centres]))
    own = F.get("_away", F.col("prediction"))
    return away.select(
        "vec_id",
        "label",
        (own <= F.array_min("_away") + TOLERANCE).alias("at_nearest"),
        F.col("prediction").between(0, len(centres) - 1).alias("cluster_in_range"),
    )


PLANE_SQL = f"""WITH {SPLIT}, numbered AS (
  SELECT doc_id, label, row_number() OVER (
    PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM split WHERE split = 'train'),
smallest AS (
  SELECT least(4000, min(n)) AS least FROM (SELECT count(*) AS n FROM numbered GROUP BY label))
SELECT doc_id, label, true AS orthogonal FROM numbered, smallest WHERE k <= least"""


@query("document_plane_properties", PLANE_SQL)
def document_plane(spark, sf_dir):
    """The balanced sample of the training rows, on two axes at right angles."""
    rows = materialise(models.document_plane(spark, sf_dir), "plane")
    x, y = F.col("x"), F.col("y")
    lengths = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    angle = rows.agg((F.abs(F.sum(x * y)) <= TOLERANCE * lengths).alias("orthogonal"))
    return rows.select("doc_id", "label").withColumn("orthogonal", angle.scalar())


@query(
    "scored_stream_properties",
    f"WITH {streams.POSTS_SQL} SELECT post_id, true AS as_in_batch FROM posts WHERE valid",
)
def scored_stream(spark, sf_dir):
    """Each valid post once, reported with the state that scoring the documents at rest gives."""
    model, _ = models.fitted_regression(spark, sf_dir)
    reported = streams.scored_stream(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    post_id = post_functions.canonical_uuid(F.md5(F.col("doc_id").cast("string")))
    at_rest = evaluation.score(model, docs.select(post_id.alias("post_id"), "text"), ("post_id",))
    expected = at_rest.select(
        "post_id", post_functions.state_of_prediction(F.col("prediction")).alias("expected")
    )
    same = F.col("misinfo_state") == F.col("expected")
    return reported.join(expected, "post_id", "left").select("post_id", same.alias("as_in_batch"))
