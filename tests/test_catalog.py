"""The named queries against their SQL equivalents, at the smallest scale."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = ["benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages"]

# one query of each kind; the rest are compared at a larger scale by the driver
COMPARED = [
    "adjusted_rand", "axis_bounds", "balanced_sample", "best_threshold", "box_stats",
    "classification_report", "clean_pages", "cluster_quality_properties", "csv_claims", "density_grid", "encoded_sequences",
    "document_plane_properties", "error_examples", "error_words", "forest_evaluation_properties",
    "forest_importance_properties", "features_three_splits", "fold_summary", "learning_folds",
    "length_stats", "logistic_regression_properties", "metrics_by_split", "model_evaluation", "padded_sequences",
    "published_once", "published_reports", "ranking_quality_by_split", "regression_scores_properties",
    "repair_text",
    "run_report", "score_histogram", "scored_stream_properties", "shuffled_labels",
    "chi_squared_terms", "density_surface", "pair_discounts", "repaired_lengths", "repaired_report", "sampled_silhouette",
    "saved_tfidf", "selected_vectors", "sequence_quality", "sequence_scores", "similar_passages", "term_regression_scores",
    "silhouette", "term_ngrams", "tfidf", "training_history_properties", "vocabulary",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_sql_has_a_query_and_runs(duck):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and set(COMPARED) <= set(oracles)
    for sql in oracles.values():
        duck.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    found = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(repr(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs and ours


def test_contract_loads_without_a_session():
    """The driver imports the contract before it starts Spark."""
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    assert contract.entry(spark).count() == 1
