"""Windowed market aggregates and collection sessions over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ratelens.functions.pricing import verified_market
from ratelens.operators.market import history_rollup


def windowed_market(priced: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count, mean, lowest and highest official price per hotel and window. These
    merge incrementally; for the exact median see ``medians``."""
    w = F.window("queried_at", length, slide) if slide else F.window("queried_at", length)
    return (
        priced.where(verified_market() & (F.col("nightly_adr_twd") > 0))
        .withWatermark("queried_at", late)
        .groupBy(w, "hotel_id")
        .agg(
            F.count("*").alias("observations"),
            F.avg("nightly_adr_twd").alias("average_twd"),
            F.min("nightly_adr_twd").alias("low"),
            F.max("nightly_adr_twd").alias("high"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "hotel_id", "observations", "average_twd", "low", "high")
    )


STREAM = ["source_platform", "hotel_id"]


def _without_run(df: DataFrame) -> DataFrame:
    return df.where("(run_id is null or run_id = '') and queried_at is not null")


def collection_sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Collection sessions of rows without a run id: a session ends when nothing
    arrives for ``gap``. Not the latest-batch rule, which looks back from the newest
    row.

    Two levels, so that no (source, hotel) is ordered as a whole: rows of equal time are
    counted, each hour of a stream becomes islands of neighbouring times, and islands of
    all hours are joined where they lie closer than the gap."""
    wide = F.expr(f"INTERVAL {gap}")
    times = _without_run(df).groupBy(*STREAM, "queried_at").agg(F.count("*").alias("n"))
    times = times.withColumn("hour", F.date_trunc("hour", "queried_at"))

    def islands(d: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start)
        new = F.coalesce(F.col(start) > F.lag(end).over(w) + wide, F.lit(True))
        return d.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    hourly = islands(times, [*STREAM, "hour"], "queried_at", "queried_at").groupBy(*STREAM, "hour", "_island").agg(
        F.min("queried_at").alias("first"), F.max("queried_at").alias("last"), F.sum("n").alias("n")
    )
    whole = islands(hourly.drop("_island"), STREAM, "first", "last")
    return whole.groupBy(*STREAM, "_island").agg(
        F.min("first").alias("session_start"), (F.max("last") + wide).alias("session_end"), F.sum("n").alias("observations")
    ).drop("_island")


def _session_parts(gap_seconds: float):
    """Islands of one task's rows of a micro-batch: (stream, first, last, n)."""

    def job(batches):
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            d = pd.concat(held, ignore_index=True).groupby([*STREAM, "queried_at"], as_index=False, dropna=False).agg(n=("n", "sum")).sort_values([*STREAM, "queried_at"])
            far = d.groupby(STREAM, dropna=False)["queried_at"].diff().dt.total_seconds()
            island = (far.isna() | (far > gap_seconds)).cumsum()
            d = d.assign(island=island).groupby([*STREAM, "island"], as_index=False, dropna=False)
            yield d.agg(first=("queried_at", "min"), last=("queried_at", "max"), n=("n", "sum"))[[*STREAM, "first", "last", "n"]]

    return job


def session_stream(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``collection_sessions`` over a stream, in append mode: a session comes out once
    the watermark, ``late`` behind the newest row, has passed its end.

    Tasks reduce their rows to islands first, so what meets in the state of a stream is a
    few rows for each task, of which Spark's session windows are made: an island lasts
    from its first row to ``gap`` after its last one."""
    seconds = pd.Timedelta(gap).total_seconds()
    rows = _without_run(df).select(*STREAM, "queried_at", F.lit(1).cast("long").alias("n"))
    parts = rows.mapInPandas(_session_parts(seconds), "source_platform string, hotel_id string, first timestamp, last timestamp, n long")
    lasts = ((F.unix_micros("last") - F.unix_micros("first")) / 1_000_000 + seconds).cast("decimal(20,6)").cast("string")
    window = F.session_window("first", F.concat(lasts, F.lit(" seconds")))
    return (
        parts.withWatermark("first", late)
        .groupBy(window, *STREAM)
        .agg(F.sum("n").alias("observations"))
        .select(*STREAM, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "observations")
    )


def start_rollups(stream: DataFrame, read_history, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the daily rollup exact: each micro-batch recomputes the days it touches
    from the history and overwrites just those partitions."""

    def write(batch: DataFrame, _epoch: int) -> None:
        days = [r.d for r in batch.select(F.to_date("queried_at").alias("d")).distinct().collect()]
        if not days:
            return
        touched = read_history(batch.sparkSession).where(F.to_date("queried_at").isin(days))
        history_rollup(touched, "daily").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
