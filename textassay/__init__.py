"""textassay: labelled-text analytics as PySpark DataFrame operators.

Sub-packages
------------
``sources``    scans and sinks (CSV claims, Parquet features, posts, reports)
``functions``  Column -> Column scalar functions (text, sequences, posts)
``operators``  DataFrame -> DataFrame operators (joins, splits, metrics, ...)
``plans``      end-to-end pipelines and Spark ML models built from operators
``streaming``  Structured Streaming scoring of JSON posts
``catalog``    the named queries, each with its ANSI SQL equivalent
"""

__version__ = "0.1.0"
