"""Score posts as they arrive: read, parse, classify, publish.

Sources are replayable and every query has a checkpoint, so a post is published
only after its micro-batch has been recorded, and a restart repeats at most the
batch that was open. Records that can not be read go to a dead-letter sink
instead of stopping the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textassay.functions import posts as fn


# The queues of posts and reports. A topic name can hold no slash.
INPUT_QUEUE, OUTPUT_QUEUE = "misinfo/input", "misinfo/output"


def read_post_files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """One JSON post per line of the files in ``path``, as column ``value``."""
    reader = spark.readStream.format("text")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def read_post_topic(spark: SparkSession, servers: str, topic: str = INPUT_QUEUE) -> DataFrame:
    """The same from a broker topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic.replace("/", "."))
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def parse_posts(raw: DataFrame) -> DataFrame:
    """``value`` with the post's fields and ``reject_reason`` (null if it is valid)."""
    post = F.col("_post")
    parsed = raw.withColumn("_post", fn.parse_post(F.col("value"))).select(
        "value",
        F.when(fn.is_uuid(post["id"]), fn.canonical_uuid(post["id"])).alias("post_id"),
        post["message"].alias("message"),
        post["username"].alias("username"),
        fn.state_code(post["misinfo_state"]).alias("misinfo_state"),
        fn.parse_date(post["date"]).alias("submitted"),
    )
    reason = (
        F.when(F.col("post_id").isNull(), "id")
        .when(F.col("message").isNull(), "message")
        .when(F.col("username").isNull(), "username")
        .when(F.col("submitted").isNull(), "date")
        .when(F.col("misinfo_state").isNull(), "misinfo_state")
    )
    return parsed.withColumn("reject_reason", reason).withColumn(
        "state_name", fn.state_name(F.col("misinfo_state"))
    )


def valid_posts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("value", "reject_reason")


def rejected_posts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("value", "reject_reason")


def without_repeats(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop a post that arrives again within ``delay``; state older than that is released.

    The clock is the arrival of the micro-batch, not the date that the sender
    wrote: no post is too late, whatever its date.
    """
    arrived = posts.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(["post_id"]).drop("_arrived")


def constant_classifier(state: str = "TRUE") -> Callable[[DataFrame], DataFrame]:
    """The placeholder that reports the same state for every post."""

    def classify(posts: DataFrame) -> DataFrame:
        code = fn.state_of_name(F.lit(state))
        return posts.select("post_id", code.alias("misinfo_state"))

    return classify


def model_classifier(model, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Reports of a fitted pipeline that reads the column ``text``."""

    def classify(posts: DataFrame) -> DataFrame:
        scored = model.transform(posts.withColumn(text, F.col("message")))
        code = fn.state_of_prediction(F.col("prediction"))
        return scored.select("post_id", code.alias("misinfo_state"))

    return classify


def reports(posts: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One JSON document per post in ``value``, keyed by the post."""
    return classify(posts).select(
        F.col("post_id").alias("key"),
        fn.report_json(F.col("post_id"), F.col("misinfo_state")).alias("value"),
    )


def publish_files(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once line files; runs until the input at hand is used up."""
    return (
        lines.select("value")
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def publish_topic(
    lines: DataFrame, servers: str, checkpoint: str, topic: str = OUTPUT_QUEUE
) -> StreamingQuery:
    """At-least-once to a broker; the key lets a reader drop a repeat."""
    return (
        lines.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic.replace("/", "."))
        .option("checkpointLocation", checkpoint)
        .start()
    )


def publish_batches(
    lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """For any other sink: ``write(batch, batch_id)`` must overwrite by ``batch_id``."""
    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_posts(
    raw: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str
) -> StreamingQuery:
    """Reports to ``out/reports`` and dead letters to ``out/rejected``.

    Each micro-batch is read and parsed once for both. Both sinks have a folder
    per batch, which a repeated batch overwrites, so every post is in exactly one of
    them, once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sinks = {
                "reports": reports(valid_posts(batch), classify).select("value"),
                "rejected": rejected_posts(batch).select(F.to_json(F.struct("*")).alias("value")),
            }
            for name, lines in sinks.items():
                lines.write.mode("overwrite").text(f"{out}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return publish_batches(parse_posts(raw), write, f"{out}/checkpoint")
