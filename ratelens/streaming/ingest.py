"""Streaming ingest with natural-key deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ratelens.operators.dedup import deduplicate, with_key_digest
from ratelens.session import shuffles_removed
from ratelens.sinks import versions
from ratelens.sinks.history import append_observations


def deduplicated_stream(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """First arrival per natural key. The key contains the day, so the state of a
    key can go once the watermark has passed it. State and shuffle hold the digest of the
    key, not its eleven texts, as in ``deduplicate``."""
    keyed = with_key_digest(stream).withWatermark("queried_at", late)
    return keyed.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


#: Bytes of Parquet, for each core, that a micro-batch of a replay reads, or one day if that has more.
REPLAY_BYTES = 64 << 20


def replay(rows: DataFrame, base: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let a stream meet a table in order of time, in micro-batches of whole days, so that
    shuffle files and state are those of some days and no row comes late. ``start(stream)``
    begins an available-now query that goes on from its checkpoint; it is run to its end for
    each portion of days.

    The rows are written once under ``base``, by day and without a shuffle of their own; a
    day that comes is moved into the folder that the stream reads, and removed when its
    micro-batch has ended. Rows without a time come first. Only the last portion is followed
    by the micro-batch without data that a watermark asks for."""
    spark = rows.sparkSession
    days, seen, idle = f"{base}/days", f"{base}/in", "spark.sql.streaming.noDataMicroBatches.enabled"
    path, before = spark._jvm.org.apache.hadoop.fs.Path, spark.conf.get(idle)
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    with shuffles_removed(spark):
        day = F.concat(F.lit("d"), F.coalesce(F.date_format("queried_at", "yyyy-MM-dd"), F.lit("")))
        rows.withColumn("_day", day).write.option("compression", "zstd").partitionBy("_day").parquet(days)
        fs.mkdirs(path(seen))
        left = sorted(f.getPath().getName() for f in fs.listStatus(path(days)) if f.isDirectory())
        bytes_of = {name: fs.getContentSummary(path(f"{days}/{name}")).getLength() for name in left}
        most = REPLAY_BYTES * spark.sparkContext.defaultParallelism
        try:
            while left:
                now = [left.pop(0)]
                while left and sum(bytes_of[name] for name in [*now, left[0]]) <= most:
                    now.append(left.pop(0))
                for name in now:
                    if not fs.rename(path(f"{days}/{name}"), path(f"{seen}/{name}")):
                        raise OSError(f"Can't move {name} to {seen}")
                spark.conf.set(idle, "false" if left else before)
                start(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(seen)).awaitTermination()
                for name in now:
                    fs.delete(path(f"{seen}/{name}"), True)
        finally:
            spark.conf.set(idle, before)


def start_ingest(stream: DataFrame, history: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exact append to the history, however late a row is: every micro-batch is
    anti-joined with the days it touches. A replayed batch writes nothing again."""

    def write(batch: DataFrame, _epoch: int) -> None:
        append_observations(batch, history)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def split_late(df: DataFrame, newest: Column, late: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(in time, late) against the newest time seen; late rows take the batch path."""
    limit = newest - F.expr(f"INTERVAL {late}")
    return df.where(F.col("queried_at") >= limit), df.where(F.col("queried_at") < limit)


_LATEST = "day string, path string, rows long, newest timestamp, late_rows long, epoch long"


def _merged(batch: DataFrame, root: str, epoch: int, late: str) -> None:
    spark = batch.sparkSession
    now = versions.current(spark, root, _LATEST)
    days = {r.day: r for r in now.collect()} if now is not None else {}  # one row a day
    if any(r.epoch >= epoch for r in days.values()):
        return  # a replay of what has been committed
    staged = f"{root}/staged/epoch={epoch}"
    dated = batch.withColumn("day", F.coalesce(F.date_format("queried_at", "yyyy-MM-dd"), F.lit("undated")))
    dated.write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(dated.schema).parquet(staged)
    mark = max((r.newest for r in days.values() if r.newest is not None), default=None)
    limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {late}")
    came = fresh.groupBy("day").agg(F.max("queried_at").alias("newest"), F.count_if(F.coalesce(F.col("queried_at") < limit, F.lit(False))).alias("late_rows"))
    came = {r.day: r for r in came.collect()}
    if not came:
        return
    touched = [days[d].path for d in came if d in days]
    rows = fresh
    if touched:
        old = spark.read.schema(batch.schema).option("basePath", f"{root}/versions").parquet(*touched)
        rows = old.select(*batch.columns).withColumn("day", F.coalesce(F.date_format("queried_at", "yyyy-MM-dd"), F.lit("undated"))).unionByName(fresh)
    path = f"{root}/versions/epoch={epoch}"
    deduplicate(rows).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    sizes = {r.day: r.n for r in spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")).collect()}
    for d, r in came.items():
        newest = max((x for x in (r.newest, days[d].newest if d in days else None) if x is not None), default=None)
        days[d] = (d, f"{path}/day={d}", sizes[d], newest, r.late_rows + (days[d].late_rows if d in days else 0), epoch)
    versions.commit(spark, root, spark.createDataFrame([tuple(r) for r in days.values()], _LATEST))


def start_latest(stream: DataFrame, root: str, checkpoint: str, late: str = "1 day", **trigger) -> StreamingQuery:
    """Keep the newest row of every natural key, in whatever order rows arrive.

    A commit remembers the newest time seen so far. Rows more than ``late`` behind it,
    which a watermark would drop, take the way of the batch job with the others: the days
    that a micro-batch touches are merged with their stored rows and written anew, all
    other days stay where they are. How many of a day's rows were late is kept."""
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: _merged(batch, root, epoch, late))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_days(spark: SparkSession, root: str) -> DataFrame:
    """Per day: rows, newest time, late rows and the micro-batch that wrote it."""
    now = versions.current(spark, root, _LATEST)
    return spark.createDataFrame([], _LATEST) if now is None else now


def read_latest(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The rows that ``start_latest`` keeps, with the columns of ``like``."""
    paths = [r.path for r in latest_days(spark, root).collect()]
    return spark.read.schema(like.schema).parquet(*paths) if paths else spark.createDataFrame([], like.schema)
