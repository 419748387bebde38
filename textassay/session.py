"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this library is planned with. Partition counts and
# memory belong to the cluster and are left to spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files are smaller than the rows read from them: judge a broadcast by the rows
    "spark.sql.sources.fileCompressionFactor": "3.0",
}


def build_session(app_name: str = "textassay", **conf: str) -> SparkSession:
    """A session with the library defaults; ``conf`` overrides them.

    Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        if key == "spark.master":
            builder = builder.master(value)
        else:
            builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` (or a checkpoint folder already set on the
    context) is used as it is. Where neither is set, a folder below the
    warehouse, which the cluster shares already.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textassay-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in this application's part of the shared folder.

    Everything an application leaves behind is below one folder named after it,
    which can be removed once the application's results have been written.
    """
    return f"{app_dir(spark)}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> bool:
    """Remove everything :func:`scratch_path` gave out to this application.

    Call it when the results that read those tables have been written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(app_dir(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.delete(path, True))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
_writers: dict[str, list] = {}  # per session, how many writes are planned now and the setting before the first


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Commands started within remove their shuffle files when they end, not when the driver collects its garbage.

    For writes only, whose shuffles nothing reads again. Several threads of a session may write at a time.
    """
    name = str(spark._jsparkSession.sessionUUID())
    with _cleaning:
        count, before = _writers.get(name, (0, spark.conf.get(CLEANUP, None)))
        _writers[name] = [count + 1, before]
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            count, before = _writers.pop(name)
            if count > 1:
                _writers[name] = [count - 1, before]
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage onto storage that outlives an executor, and gives Catalyst
    the table's true size: a join against it is broadcast when the files fit
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when they do not. What the write shuffled goes when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with cleaned_shuffles(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Remove a table of :func:`materialise` that nothing reads again."""
    spark = stored.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if f"/textassay-{spark.sparkContext.applicationId}/" in folder:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_BYTES = 64 << 20  # of the rows of a table, at most


def is_small(table: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether a stored table's rows take up to ``max_bytes``, by default ``BROADCAST_BYTES``.

    The row count comes from the Parquet footers, so a table too long to qualify is never read.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    fixed = 16 * len(table.columns)
    if table.count() * fixed > limit:
        return False
    texts = [F.octet_length(name) for name, kind in table.dtypes if kind == "string"]
    numbers = [8 * F.greatest(F.size(name), F.lit(0)) for name, kind in table.dtypes if kind == "array<double>"]
    lengths = [F.coalesce(length, F.lit(0)) for length in texts + numbers]
    measured = table.agg(F.sum(sum(lengths, F.lit(fixed)).cast("long")).alias("bytes")).first()["bytes"] or 0
    return measured <= limit


def sized(table: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``table`` with the join strategy that its measured size allows.

    For joins whose other side is exploded: Catalyst does not know how many rows
    an explode makes and would take that side for the small one. A small table (see
    :func:`is_small`) is broadcast, any other is sort-merge joined.
    """
    return F.broadcast(table) if is_small(table, max_bytes) else table.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for per-row text work on a scan of few splits.

    A scan with at least as many splits as the cluster has cores is left alone,
    so that large inputs are not shuffled. Only for plain scans: asking one for
    its splits runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
