from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textassay.streaming import posts

GOOD = {
    "id": "6f9619ff-8b86-4d01-b42d-00c04fc964ff",
    "message": "m",
    "username": "u",
    "misinfo_state": 2,
    "date": "2024-01-01T00:00:00",
}


def lines(spark, *records):
    text = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return spark.createDataFrame(text, "value string")


def test_a_good_post(spark):
    parsed = posts.parse_posts(lines(spark, GOOD))
    row = posts.valid_posts(parsed).first()
    assert (row["post_id"], row["state_name"], row["message"]) == (GOOD["id"], "NOT_CHECKED", "m")
    assert row["submitted"].isoformat() == "2024-01-01T00:00:00"


def test_bad_posts_go_to_the_dead_letters(spark):
    bad = [
        {**GOOD, "misinfo_state": 7},
        {**GOOD, "id": "abc"},
        {**GOOD, "date": "soon"},
        {k: v for k, v in GOOD.items() if k != "message"},
        "{not json",
    ]
    parsed = posts.parse_posts(lines(spark, *bad))
    assert posts.valid_posts(parsed).count() == 0
    reasons = [r["reject_reason"] for r in posts.rejected_posts(parsed).collect()]
    assert reasons == ["misinfo_state", "id", "date", "message", "id"]


def test_report_json(spark):
    parsed = posts.valid_posts(posts.parse_posts(lines(spark, GOOD)))
    out = posts.reports(parsed, posts.constant_classifier("FAKE")).first()
    assert out["key"] == GOOD["id"]
    assert json.loads(out["value"]) == {"post_id": GOOD["id"], "misinfo_state": 0}


def post_number(i):
    return {**GOOD, "id": f"6f9619ff-8b86-4d01-b42d-{i:012d}", "message": "x" * (i % 5)}


def by_length(df):
    """A classifier with more than one answer."""
    return df.select("post_id", (F.length("message") % 2).alias("misinfo_state"))


def test_stream_equals_batch_and_restart_repeats_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = lines(spark, *[post_number(i) for i in range(40)], {**GOOD, "id": "abc"})
    first.repartition(4).write.text(source)
    stream = posts.read_post_files(spark, source, per_batch=1)
    posts.score_posts(stream, by_length, out).awaitTermination()
    assert spark.read.text(f"{out}/reports").count() == 40
    assert spark.read.text(f"{out}/rejected").count() == 1
    more = lines(spark, *[post_number(i) for i in range(40, 50)])
    more.write.mode("append").text(source)
    posts.score_posts(posts.read_post_files(spark, source), by_length, out).awaitTermination()
    streamed = sorted(r["value"] for r in spark.read.text(f"{out}/reports").collect())
    batch = posts.reports(
        posts.valid_posts(posts.parse_posts(first.unionByName(more))), by_length
    )
    assert streamed == sorted(r["value"] for r in batch.collect()) and len(streamed) == 50


def test_batches_can_be_written_again(spark, tmp_path):
    """A sink that overwrites by batch number gives the same result when replayed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lines(spark, *[post_number(i) for i in range(5)]).write.text(source)

    def write(batch, batch_id):
        for _ in range(2):
            batch.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    valid = posts.valid_posts(posts.parse_posts(posts.read_post_files(spark, source)))
    good = posts.reports(valid, by_length)
    posts.publish_batches(good, write, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(out).count() == 5


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lines(spark, *[post_number(i) for i in range(10)]).coalesce(1).write.text(source)
    lines(spark, *[post_number(i) for i in range(10)]).coalesce(1).write.mode("append").text(source)
    raw = posts.read_post_files(spark, source, per_batch=1)
    once = posts.without_repeats(posts.valid_posts(posts.parse_posts(raw)))
    posts.publish_files(posts.reports(once, by_length), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(out).count() == 10


@pytest.mark.parametrize(
    "dates",
    [
        ["2024-01-02T00:00:00", "2024-01-02T00:10:00", "2024-01-01T00:00:00"],
        ["2099-01-01T00:00:00", "2024-01-02T00:00:00", "2024-01-01T00:00:00"],
    ],
)
def test_no_post_is_lost_for_its_date(spark, tmp_path, dates):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, date in enumerate(dates):
        post = lines(spark, {**post_number(i), "date": date})
        post.coalesce(1).write.mode("append").text(source)
    raw = posts.read_post_files(spark, source, per_batch=1)
    once = posts.without_repeats(posts.valid_posts(posts.parse_posts(raw)))
    posts.publish_files(posts.reports(once, by_length), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(out).count() == len(dates)


def test_other_spellings_of_an_id(spark):
    spellings = ["{%s}", "urn:uuid:%s", "%s"]
    records = [{**GOOD, "id": s % GOOD["id"].upper()} for s in spellings]
    records.append({**GOOD, "id": GOOD["id"].replace("-", "")})
    parsed = posts.valid_posts(posts.parse_posts(lines(spark, *records)))
    assert [r["post_id"] for r in parsed.collect()] == [GOOD["id"]] * 4
