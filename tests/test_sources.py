from __future__ import annotations

import pytest

from textassay.session import materialise, scratch_path, shared_dir, sized
from textassay.sources import claims, features, reports


def write_file(tmp_path, data: bytes):
    path = tmp_path / "claims.csv"
    path.write_bytes(data)
    return str(path)


def test_claims_csv(spark, tmp_path):
    path = write_file(
        tmp_path,
        b'id,claim,label,source\n1,"two\nlines, ""quoted""",1,a\n2,NA,0,a\n3,b\xff,0,b\n4,c,,b\n',
    )
    got = [tuple(r) for r in claims.read_claims(spark, path).collect()]
    assert got == [('two\nlines, "quoted"', 1), (None, 0), ("b�", 0), ("c", None)]


def test_bad_label_is_an_error(spark, tmp_path):
    path = write_file(tmp_path, b"claim,label\na,x1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        claims.read_claims(spark, path).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_claims_round_trip(spark, tmp_path, fmt):
    rows = [('a "b"', 1), ("c,\nd", 0)]
    df = spark.createDataFrame(rows, "claim string, label int")
    path = str(tmp_path / fmt)
    claims.write_claims(df, path, fmt)
    back = claims.read_claims(spark, path) if fmt == "csv" else spark.read.parquet(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_features_are_pruned_by_split(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame(
        [(1, "train", 0.1), (2, "val", 0.2), (3, "test", 0.3)], "doc_id long, split string, x double"
    )
    features.write_features(df, path)
    train = features.load_features(spark, path, "train")
    assert [r["doc_id"] for r in train.collect()] == [1]
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    assert [part.count() for part in features.load_splits(spark, path)] == [1, 1, 1]
    assert features.load_features(spark, path).count() == 3
    with pytest.raises(ValueError, match="unknown split"):
        features.load_features(spark, path, "dev")


def test_report_file(spark, tmp_path):
    path = str(tmp_path / "report")
    reports.write_report(spark.range(1).selectExpr("named_struct('n', 3) AS splits"), path)
    assert spark.read.json(path).first()["splits"]["n"] == 3


def test_shared_folder_is_the_sessions_own(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(folder)


def test_stored_table_has_a_known_size(spark):
    """A join with a stored small table is broadcast without any hint."""
    small = materialise(spark.range(10), "small")
    joined = spark.range(1000).join(small, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize(
    "limits, strategy",
    [({}, "BroadcastHashJoin"), ({"max_bytes": 5}, "SortMergeJoin")],
)
def test_broadcast_follows_the_measured_size(spark, limits, strategy):
    table = materialise(spark.range(10).selectExpr("id", "cast(id as string) AS w"), "table")
    joined = spark.range(1000).join(sized(table, **limits), "id")
    assert strategy in joined._jdf.queryExecution().executedPlan().toString()


def test_fractional_label_is_an_error(spark, tmp_path):
    path = write_file(tmp_path, b"claim,label\na,0.7\n")
    with pytest.raises(Exception, match="not a whole number: 0.7"):
        claims.read_claims(spark, path).collect()


def test_enriched_columns_are_found_by_name(spark, tmp_path):
    path = write_file(tmp_path, b"all_caps,content,hedge_words_count,category\n3,c,2,x\n,d,1.0,\n")
    got = claims.read_enriched_posts(spark, path, ["hedge_words_count", "content", "all_caps"])
    assert [tuple(r) for r in got.collect()] == [(2, "c", 3), (1, "d", None)]


def test_bad_count_is_an_error(spark, tmp_path):
    path = write_file(tmp_path, b"content,symbols\na,many\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        claims.read_enriched_posts(spark, path, ["symbols"]).collect()
