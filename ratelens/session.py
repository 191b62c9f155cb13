"""Session settings that the library relies on, and the lineage-cut helper."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: safe to apply to a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rows travel to Python in batches of at most so many bytes (or one row), not only of
    # 10,000 rows: a task's memory must not grow with the length of texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# Rates take some 20 times their Parquet size in memory: a task that sorts the rows of one
# split, as deduplication does, would need gigabytes at Spark's default of 128 MB.
RATES_CONF = {**RUNTIME_CONF, "spark.sql.files.maxPartitionBytes": "32m"}


def configure(spark: SparkSession, conf: dict[str, str] = RUNTIME_CONF) -> SparkSession:
    """Apply the runtime settings; a no-op where they already hold."""
    for key, value in conf.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "ratelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RATES_CONF, **{k: str(v) for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate(), RATES_CONF)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates, which driver and executors share: what the
    cluster names in ``spark.checkpoint.dir``. Where nothing is named, as in tests, it
    is a folder inside the warehouse, which they share as well; never a machine-local
    temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    root = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Shuffle files go when the execution that made them ends, not when the driver next
#: collects garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict[str, tuple[int, str | None]] = {}  # by session: writes under way, the setting before
_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files. The setting is restored when the last
    of several threads leaves."""
    key = str(spark._jsparkSession.sessionUUID())
    with _lock:
        n, before = _writing.get(key, (0, spark.conf.get(_SHUFFLE_CLEANUP, None)))
        _writing[key] = n + 1, before
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_SHUFFLE_CLEANUP)
            else:
                spark.conf.set(_SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. Unlike a cached
    copy it outlives executors, and scans of it prune and push down. Each call writes
    to a place of its own, so two jobs of one session never meet; ``release`` removes
    all of them. A write is planned anew and shares no shuffle with other executions, so
    its shuffle files are removed as soon as the table is written."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every intermediate that this application has written. Call it when the
    results that read them have been written out."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
