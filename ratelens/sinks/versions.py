"""Commits: which files make up a table that is rewritten while others read it.

New files always go to a new place. A commit is a small table that lists the current
places; it counts from the moment its ``_SUCCESS`` is there, so a reader sees the state
before or after a rewrite, and a writer that dies leaves the state before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` has ended."""
    done, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


def holds_files(spark: SparkSession, pattern: str) -> bool:
    path, fs = _path(spark, pattern)
    return bool(fs.globStatus(path))


def commits(spark: SparkSession, root: str) -> list[str]:
    """Finished commits, oldest first."""
    path, fs = _path(spark, f"{root}/manifests")
    found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(p.getName() for p in found if finished(spark, p.toString()))


def commit(spark: SparkSession, root: str, rows: DataFrame) -> str:
    """Make ``rows``, a small table, the current state."""
    last = commits(spark, root)
    path = f"{root}/manifests/{int(last[-1].split('-')[0]) + 1 if last else 0:010d}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.json(path)
    return path


def current(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    done = commits(spark, root)
    return spark.read.schema(schema).json(f"{root}/manifests/{done[-1]}") if done else None
