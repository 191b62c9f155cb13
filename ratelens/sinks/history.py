"""The append-only history and its maintenance jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ratelens.functions.pricing import as_col
from ratelens.operators.dedup import KEY_COLUMNS, dedup_counts, deduplicate, one_per_digest, with_key_digest, with_natural_key
from ratelens.schema import LEGACY_DEFAULTS, RATE_SCHEMA, conform
from ratelens.session import shuffles_removed
from ratelens.sinks import versions
from ratelens.sources.observations import RAW_SCHEMA, read_months, source_ledger


def with_day_partitions(df: DataFrame) -> DataFrame:
    return df.withColumns({"month": F.date_format("queried_at", "yyyy-MM"), "day": F.date_format("queried_at", "yyyy-MM-dd")})


def read_history(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """History written by ``append_observations``; ``days`` prunes partitions."""
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("month", T.StringType()), T.StructField("day", T.StringType())])
    h = spark.read.schema(schema).json(path)
    if days is not None:
        h = h.where(F.col("day").isin(days))
    return conform(h.drop("month", "day"), RATE_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_observations(df: DataFrame, path: str, compression: str = "none") -> int:
    """Append rows whose natural key their day does not hold yet, the earliest of
    the batch per key; return how many were written.

    Keys contain the day, so only partitions the batch touches are read. ``compression``
    is that of the files added, ``gzip`` or ``none``, whatever the others have. Rows are shuffled
    once, with the digest of their key; old rows send nothing but theirs."""
    spark = df.sparkSession
    fresh = one_per_digest(with_key_digest(df), keep="first")
    if _exists(spark, path):
        # One value per calendar day in the batch.
        days = [r.d for r in df.select(F.date_format("queried_at", "yyyy-MM-dd").alias("d")).distinct().collect()]
        old = with_key_digest(read_history(spark, path, days)).select("_digest").distinct()
        fresh = fresh.join(old, "_digest", "left_anti")
    seen = Observation("append-" + uuid.uuid4().hex)
    out = with_day_partitions(fresh.drop("_digest")).observe(seen, F.count("*").alias("n"))
    with shuffles_removed(spark):
        out.write.mode("append").option("ignoreNullFields", "false").option("compression", compression).partitionBy("month", "day").json(path)
    return seen.get["n"]


def new_observations(df: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows an append would write, as a table."""
    fresh = with_natural_key(deduplicate(df, keep="first"))
    old = with_natural_key(existing).select(*KEY_COLUMNS).distinct()
    return fresh.join(old, list(KEY_COLUMNS), "left_anti").drop(*KEY_COLUMNS)


def record_digest(df: DataFrame):
    """Digest of a record's canonical JSON: columns by name, nulls kept."""
    names = sorted(c for c in df.columns if c not in ("month", "day"))
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Digests that the two sides do not hold equally often."""
    both = a.select(record_digest(a).alias("digest"), F.lit(1).alias("n")).unionByName(
        b.select(record_digest(b).alias("digest"), F.lit(-1).alias("n"))
    )
    return both.groupBy("digest").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def _fingerprint(df: DataFrame) -> list[Column]:
    """Rows and the sums of both halves of their records' digests: equal for the same
    multiset of records in any order, and additive."""
    names = sorted(c for c in df.columns if c not in ("month", "day"))
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    halves = {"hi": F.xxhash64(record), "lo": F.xxhash64(F.lit("low"), record)}
    sums = [F.coalesce(F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string"), F.lit("0")).alias(c) for c, h in halves.items()]
    return [F.count("*").alias("rows"), *sums]


def to_daily_partitions(source: DataFrame, target: str) -> int:
    """Rewrite monthly data into day partitions of compressed JSON and verify it as a
    multiset of records. Refuses a target that already exists and rows without a time.

    The records are fingerprinted by 128 bits on their way into the writer and again as
    they are read back, so neither side is shuffled; only if the fingerprints differ are
    records compared one by one."""
    spark = source.sparkSession
    if _exists(spark, target):
        raise RuntimeError(f"Refusing to mix layouts: {target} exists")
    if source.where(F.col("queried_at").isNull()).limit(1).count():
        raise ValueError("rows with invalid queried_at")
    seen = Observation("daily-" + uuid.uuid4().hex)
    out = with_day_partitions(source.observe(seen, *_fingerprint(source)))
    out.write.option("ignoreNullFields", "false").option("compression", "gzip").partitionBy("month", "day").json(target)
    back = read_history(spark, target).select(*source.columns)
    found = back.agg(*_fingerprint(back)).first()
    if not found.rows and source.isEmpty():  # Spark reports no metrics of an empty table
        return 0
    if any(found[c] != seen.get[c] for c in ("rows", "hi", "lo")):
        bad = multiset_difference(source, back).limit(5).collect()
        raise RuntimeError(f"Migration verification failed: record sets differ: {bad}")
    return found.rows


def _missing(c: str):
    text = as_col(c).cast("string")
    return text.isNull() | (text == "")


def backfill_legacy(df: DataFrame) -> DataFrame:
    """Fill the key dimensions that old rows lack."""
    return df.withColumns(
        {c: F.when(_missing(c), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in LEGACY_DEFAULTS.items()}
    )


def backfill_counts(df: DataFrame) -> DataFrame:
    """How many rows each default fills, and rows that have no safe default."""
    return df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_missing(c)).alias(f"filled_{c}") for c in LEGACY_DEFAULTS],
        *[F.count_if(_missing(c)).alias(f"missing_{c}") for c in ("check_out", "currency")],
    )


def key_collisions(df: DataFrame) -> DataFrame:
    return with_natural_key(df).groupBy(*KEY_COLUMNS).agg(F.count("*").alias("rows")).where("rows > 1")


def assert_backfill(df: DataFrame) -> DataFrame:
    """Gate and result: fail on rows without a safe default or colliding keys."""
    c = backfill_counts(df).first()
    if c.missing_check_out or c.missing_currency:
        raise ValueError("rows are missing check_out or currency")
    filled = backfill_legacy(df)
    if key_collisions(filled).limit(1).count():
        raise RuntimeError("Expanded natural key collision detected")
    return filled


def deduplicate_history(source: DataFrame, target: str) -> DataFrame:
    """Write the deduplicated history next to the source, to a place that doesn't exist
    yet; report before and after. To rewrite a history in place see ``rewrite_history``."""
    spark = source.sparkSession
    if _exists(spark, target):
        raise RuntimeError(f"Refusing to mix histories: {target} exists")
    with_day_partitions(deduplicate(source)).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("month", "day").json(target)
    return dedup_counts(source)


_REWRITTEN = "month string, path string, rows_before long, rows_after long, records string"


def _records(df: DataFrame) -> list[Column]:
    """Rows and an order-independent fingerprint of whole records."""
    names = sorted(RATE_SCHEMA.names)
    record = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    return [F.count("*").alias("rows"), F.coalesce(F.sum(record.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string"), F.lit("0")).alias("records")]


def rewrite_history(spark: SparkSession, source: str, root: str, job: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rewrite a JSON history month by month by ``change``, and make the result current
    under ``root`` once all months are done. Returns (month, path, rows_before,
    rows_after, records).

    Each month is read once, written to a place of its own in day folders, and read back
    to compare its records with what went in. A finished month leaves a progress note
    named after the digest of its source files, so a run that follows a broken one goes on
    with the first month that has none, and months whose files have changed since are
    done again. ``change`` must not move rows between months."""
    done = []
    for m in sorted(source_ledger(spark, source).collect(), key=lambda r: r.month):  # one row a month
        name = f"{job}/{m.month}-{m.digest[:16]}"
        note, place = f"{root}/progress/{name}", f"{root}/versions/{name}"
        if not versions.finished(spark, note):
            before, after = Observation(uuid.uuid4().hex), Observation(uuid.uuid4().hex)
            rows = change(read_months(spark, source, [m.month]).observe(before, F.count("*").alias("n")))
            rows = conform(rows, RATE_SCHEMA)
            out = with_day_partitions(rows.observe(after, *_records(rows))).drop("month")
            out.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").partitionBy("day").json(place)
            back = conform(spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").json(place), RATE_SCHEMA)
            found = back.agg(*_records(back)).first()
            if (found.rows, found.records) != (after.get["rows"], after.get["records"]):
                raise RuntimeError(f"Rewrite verification failed: {m.month} has {found}, expected {after.get}")
            row = (m.month, place, before.get["n"], found.rows, found.records)
            spark.createDataFrame([row], _REWRITTEN).coalesce(1).write.mode("overwrite").json(note)
        done.append(note)
    report = spark.read.schema(_REWRITTEN).json(done) if done else spark.createDataFrame([], _REWRITTEN)
    versions.commit(spark, root, report)
    return report


def read_rewritten(spark: SparkSession, root: str) -> DataFrame:
    """The history that the last finished ``rewrite_history`` made current."""
    now = versions.current(spark, root, _REWRITTEN)
    paths = [r.path for r in now.collect()] if now is not None else []
    if not paths:
        return spark.createDataFrame([], RATE_SCHEMA)
    # Days are folders of each month's own place, so they are not read as partitions.
    return conform(spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").json(paths), RATE_SCHEMA)


def split_run(df: DataFrame, run_id: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the run, all other rows)."""
    mine = df.where(F.col("run_id") == run_id)
    if strict and not mine.limit(1).count():
        raise ValueError(f"Run id not found: {run_id}")
    return mine, df.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))


__all__ = [
    "append_observations", "assert_backfill", "backfill_counts", "backfill_legacy", "deduplicate_history",
    "key_collisions", "multiset_difference", "new_observations", "read_history", "read_rewritten", "record_digest", "rewrite_history", "split_run",
    "to_daily_partitions", "with_day_partitions",
]
