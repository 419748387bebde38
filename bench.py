"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Each query runs to its last row through the ``noop`` sink, so that no result is
collected or cut short.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textassay.catalog import QUERIES  # noqa: E402
from textassay.session import build_session, release  # noqa: E402

HEADLINE = [
    "recommended_length",
    "clean_text",
    "term_ngrams",
    "style_counts",
    "repair_text",
    "stratified_split",
    "vocabulary",
    "padded_sequences",
    "document_frequencies",
    "tfidf",
    "error_words",
    "classification_report",
    "ranking_quality",
    "best_threshold",
    "box_stats",
    "published_reports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_counts"](spark, sf_dir).collect()  # start the JVM's compilers
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
