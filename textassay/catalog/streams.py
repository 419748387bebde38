"""Posts derived from the documents, parsed and scored as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from textassay.catalog.base import query, table
from textassay.catalog.models import fitted_regression
from textassay.functions import posts as fn
from textassay.session import scratch_path
from textassay.streaming import posts

HEX = "md5(CAST(doc_id AS VARCHAR))"
UUID_SQL = " || '-' || ".join(f"substr({HEX}, {a}, {n})" for a, n in
                              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

# every 11th id, 13th date and 4th state code is not one
POSTS_SQL = f"""posts AS (
  SELECT doc_id, {UUID_SQL} AS post_id, text, source,
    doc_id % 11 <> 0 AND text IS NOT NULL AND doc_id % 13 <> 5 AND doc_id % 4 <> 3 AS valid,
    CASE WHEN doc_id % 11 = 0 THEN 'id' WHEN text IS NULL THEN 'message'
         WHEN doc_id % 13 = 5 THEN 'date' ELSE 'misinfo_state' END AS reason
  FROM documents)"""


def post_lines(spark, sf_dir):
    """Every document as one JSON post, some of them faulty."""
    key = F.col("doc_id")
    bare = F.md5(key.cast("string"))
    post_id = F.when(key % 11 == 0, F.concat(F.lit("abc"), bare)).otherwise(fn.canonical_uuid(bare))
    seconds = F.timestamp_seconds(F.lit(1704067200) + key)
    date = F.when(key % 13 == 5, "soon").otherwise(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "documents").select(
        F.to_json(
            F.struct(
                post_id.alias("id"),
                F.col("text").alias("message"),
                F.col("source").alias("username"),
                (key % 4).alias("misinfo_state"),
                date.alias("date"),
            )
        ).alias("value")
    )


def post_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "posts")
    post_lines(spark, sf_dir).write.text(path)
    return path


@query(
    "parsed_posts",
    f"""WITH {POSTS_SQL} SELECT post_id, text AS message, source AS username,
  CAST(doc_id % 4 AS INTEGER) AS misinfo_state,
  CASE doc_id % 4 WHEN 0 THEN 'FAKE' WHEN 1 THEN 'TRUE' ELSE 'NOT_CHECKED' END AS state_name,
  1704067200 + doc_id AS submitted FROM posts WHERE valid""",
)
def parsed_posts(spark, sf_dir):
    valid = posts.valid_posts(posts.parse_posts(post_lines(spark, sf_dir)))
    return valid.withColumn("submitted", F.unix_timestamp("submitted"))


@query(
    "rejected_posts",
    f"""WITH {POSTS_SQL} SELECT reason AS reject_reason, count(*) AS n
FROM posts WHERE NOT valid GROUP BY reason""",
)
def rejected_posts(spark, sf_dir):
    bad = posts.rejected_posts(posts.parse_posts(post_lines(spark, sf_dir)))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "published_reports",
    f"""WITH {POSTS_SQL} SELECT
  '{{"post_id":"' || post_id || '","misinfo_state":1}}' AS value FROM posts WHERE valid""",
)
def published_reports(spark, sf_dir):
    """Stream of post files through the constant classifier to report files."""
    out = scratch_path(spark, "stream")
    raw = posts.read_post_files(spark, post_files(spark, sf_dir))
    posts.score_posts(raw, posts.constant_classifier(), out).awaitTermination()
    return spark.read.text(f"{out}/reports").select("value")


@query(
    "dead_letters",
    f"""WITH {POSTS_SQL} SELECT reason AS reject_reason, count(*) AS n
FROM posts WHERE NOT valid GROUP BY reason""",
)
def dead_letters(spark, sf_dir):
    out = scratch_path(spark, "stream")
    raw = posts.read_post_files(spark, post_files(spark, sf_dir))
    posts.score_posts(raw, posts.constant_classifier(), out).awaitTermination()
    lines = spark.read.schema("value string, reject_reason string").json(f"{out}/rejected")
    return lines.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "published_once",
    f"WITH {POSTS_SQL} SELECT post_id, 1 AS n FROM posts WHERE valid",
)
def published_once(spark, sf_dir):
    """Every post sent again after a restart, each reported once (state bounded by a watermark)."""
    path, out = scratch_path(spark, "posts"), scratch_path(spark, "stream")
    for _ in range(2):
        post_lines(spark, sf_dir).write.mode("append").text(path)
        valid = posts.valid_posts(posts.parse_posts(posts.read_post_files(spark, path)))
        lines_out = posts.reports(posts.without_repeats(valid), posts.constant_classifier())
        posts.publish_files(lines_out, f"{out}/reports", f"{out}/checkpoint").awaitTermination()
    published = spark.read.schema("post_id string, misinfo_state int").json(f"{out}/reports")
    return published.groupBy("post_id").agg(F.count("*").cast("int").alias("n"))


@query("scored_stream")
def scored_stream(spark, sf_dir):
    """The same stream through a fitted text classifier."""
    model, _ = fitted_regression(spark, sf_dir)
    out = scratch_path(spark, "stream")
    raw = posts.read_post_files(spark, post_files(spark, sf_dir))
    posts.score_posts(raw, posts.model_classifier(model), out).awaitTermination()
    lines = spark.read.schema("post_id string, misinfo_state int").json(f"{out}/reports")
    return lines.select("post_id", "misinfo_state")
