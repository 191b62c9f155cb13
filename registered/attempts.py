"""STR2-STR6, W8-W9: adapter health and the streaming forms, batch and stream.

A streaming query runs over all its input with an available-now trigger and writes to
the shared folder, so that the result is the whole table's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelens.operators import health
from ratelens.operators.dedup import KEY_COLUMNS, with_natural_key
from ratelens.session import shared_folder
from ratelens.streaming.health import daily_health_stream, health_stream
from ratelens.streaming.ingest import deduplicated_stream, latest_days, read_latest, replay, split_late, start_latest
from ratelens.streaming.market import collection_sessions, session_stream, windowed_market
from ratelens.streaming.medians import median_stream
from registered.batches import _KEYED
from registered.book import day, query, r, ts
from registered.view import SQL_PRICED, mirror_rows, observations, rates, sql, table


def shape_attempts(events: DataFrame) -> DataFrame:
    """Events as an attempt log."""
    e = F.col("event_type")
    return events.select(
        F.lit("web").alias("adapter"), F.col("user_id").cast("string").alias("hotel_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(e == "error", F.lit("failure")).when(e == "signup", F.lit("empty")).otherwise(F.lit("success")).alias("outcome"),
        F.when((e == "error") & (F.col("event_id") % 5 == 0), F.lit(403)).alias("status_code"),
        F.col("value").alias("duration_ms"), F.concat(e, F.lit(" seen")).alias("reason"),
    )


def attempts(spark, sf):
    return shape_attempts(table(spark, sf, "events"))


_A = """
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS hotel_id, ts, event_id AS seq, value AS ms, event_type = 'error' AS bad, event_type = 'signup' AS empty,
             event_type = 'error' AND event_id % 5 = 0 AS blocked FROM events),
b AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY hotel_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island,
        CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) OVER (PARTITION BY hotel_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS blocked_count FROM a),
c AS (SELECT *, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY hotel_id, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM b),
d AS (SELECT *, CASE WHEN blocked THEN least(10080.0, 1440.0 * pow(2, least(blocked_count - 1, 40))) WHEN bad AND streak >= 2 THEN least(10080.0, 360.0 * pow(2, least(streak - 2, 40))) END AS minutes FROM c),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY ts DESC, seq DESC) = 1),
s AS (SELECT hotel_id, count(*) AS n, count_if(NOT bad AND NOT empty) AS ok, count_if(bad) AS fails, count_if(empty) AS empties, count_if(blocked) AS blocks, sum(greatest(ms, 0)) AS ms,
        max(ts) FILTER (NOT bad AND NOT empty) AS last_ok FROM a GROUP BY 1)
"""
_STATE = """
SELECT hotel_id, CAST(n AS BIGINT) AS attempts, CAST(ok AS BIGINT) AS successes, CAST(fails AS BIGINT) AS failures, CAST(empties AS BIGINT) AS empty_responses,
  CAST(blocks AS BIGINT) AS blocked_count, CAST(streak AS BIGINT) AS consecutive_failures, CASE WHEN l.blocked THEN 'blocked' WHEN l.bad THEN 'failed' WHEN l.empty THEN 'empty' ELSE 'success' END AS last_status,
  strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS last_attempt_at, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_success_at,
  strftime(l.ts + to_seconds(CAST(l.minutes * 60 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS cooldown_until{extra}
FROM s JOIN l USING (hotel_id)
"""
_STATE_COLS = ["hotel_id", "attempts", "successes", "failures", "empty_responses", "blocked_count", "consecutive_failures", "last_status"]
_STATE_TIMES = ["last_attempt_at", "last_success_at", "cooldown_until"]


@query("STR2_health_state_batch", _A + _STATE.format(extra=", round(ok * 1.0 / (ok + fails), 4) AS success_rate, round(s.ms / n, 2) AS average_response_ms"))
def str2(spark, sf):
    d = health.public_health(health.health_state(attempts(spark, sf))).join(
        health.health_state(attempts(spark, sf)).select("hotel_id", "consecutive_failures"), "hotel_id"
    )
    return d.select(*_STATE_COLS, *[ts(c).alias(c) for c in _STATE_TIMES], "success_rate", "average_response_ms")


@query("W8_W9_attempt_states", _A + """
SELECT CAST(seq AS BIGINT) AS seq, hotel_id, CAST(CASE WHEN bad THEN streak ELSE 0 END AS BIGINT) AS consecutive_failures, blocked_count, CAST(minutes AS DOUBLE) AS cooldown_minutes FROM d""")
def w8(spark, sf):
    d = health.attempt_states(attempts(spark, sf))
    return d.select("seq", "hotel_id", F.when(F.col("is_failure"), F.col("consecutive_failures")).otherwise(F.lit(0)).cast("long").alias("consecutive_failures"), "blocked_count", "cooldown_minutes")


@query("STR3_daily_health", _A + """
SELECT hotel_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS attempts, CAST(count_if(NOT bad AND NOT empty) AS BIGINT) AS successes, CAST(count_if(bad) AS BIGINT) AS failures,
  CAST(count_if(blocked) AS BIGINT) AS blocked_count, round(sum(ms) / count(*), 4) AS mean_ms,
  CASE WHEN count_if(NOT empty) > 0 THEN round(count_if(NOT bad AND NOT empty) * 1.0 / count_if(NOT empty), 4) END AS success_rate
FROM a GROUP BY ALL""")
def str3(spark, sf):
    d = health.daily_health(attempts(spark, sf))
    return d.select(
        "hotel_id", day("day").alias("day"), "attempts", "successes", "failures", "blocked_count",
        r(F.col("total_response_ms") / F.col("attempts"), 4).alias("mean_ms"), "success_rate",
    )


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

        q = stream.writeStream.foreachBatch(write).outputMode(mode)
    q.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out") if mode == "append" else spark.read.parquet(f"{base}/out")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def observation_stream(spark: SparkSession, sf: str) -> DataFrame:
    mirror = observations(spark, sf)
    path = mirror.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(mirror.schema).parquet(path)


def rocksdb(spark: SparkSession, job):
    """Run ``job`` with the state store that keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return job()
    finally:
        spark.conf.set(key, before)


def in_batches(spark: SparkSession, parts: list[DataFrame], start) -> str:
    """Let a stream meet ``parts`` one after another, each as one micro-batch.
    ``start(stream, base)`` begins a query that goes on from its checkpoint."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{base}/in"), base).awaitTermination()
    return base


def newest_output(spark: SparkSession, parts: list[DataFrame], build, keys: list[str]) -> DataFrame:
    """The last row that an updating stream wrote for each key, over all ``parts``."""

    def start(stream, base):
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

        return build(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()

    out = spark.read.parquet(f"{in_batches(spark, parts, start)}/out")
    rest = [c for c in out.columns if c not in (*keys, "epoch", "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s")).select(*keys, "s.*")


@query("STR2_health_state_stream", _A + _STATE.format(extra=""))
def str2s(spark, sf):
    out = rocksdb(spark, lambda: drain(spark, health_stream(shape_attempts(event_stream(spark, sf))), "update"))
    # The newest state of a pair wins.
    last = out.groupBy("hotel_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "hotel_id"]), "epoch").alias("s")).select("hotel_id", "s.*")
    return last.select(*_STATE_COLS, *[ts(c).alias(c) for c in _STATE_TIMES])


@query("STR2_hot_pair_in_batches", _A.replace("CAST(user_id AS VARCHAR) AS hotel_id", "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS hotel_id") + _STATE.format(extra=""))
def str2h(spark, sf):
    """One pair holds a third of all attempts; four micro-batches in time order."""
    events = table(spark, sf, "events")
    a = shape_attempts(events).withColumn("hotel_id", F.when(F.col("hotel_id").cast("long") % 3 == 0, F.lit("hot")).otherwise(F.col("hotel_id")))
    first, last = a.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / 4 for i in range(1, 4)]
    quarter = sum((F.col("ts") > F.lit(c)).cast("int") for c in cuts)
    parts = [a.where(quarter == i) for i in range(4)]
    out = rocksdb(spark, lambda: newest_output(spark, parts, health_stream, ["adapter", "hotel_id"]))
    return out.select(*_STATE_COLS, *[ts(c).alias(c) for c in _STATE_TIMES])


@query("STR3_daily_health_stream", _A + """
SELECT hotel_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS attempts, CAST(count_if(NOT bad AND NOT empty) AS BIGINT) AS successes, CAST(count_if(bad) AS BIGINT) AS failures,
  CAST(count_if(blocked) AS BIGINT) AS blocked_count FROM a GROUP BY ALL""")
def str3s(spark, sf):
    out = drain(spark, daily_health_stream(shape_attempts(event_stream(spark, sf))), "update")
    # An updated window is written again; the last version is the complete one.
    last = out.groupBy("hotel_id", "day").agg(F.max_by(F.struct("attempts", "successes", "failures", "blocked_count"), "epoch").alias("s"))
    return last.select("hotel_id", day("day").alias("day"), "s.*")


@query("STR1_deduplicated_stream", sql("SELECT natural_key, CAST(1 AS BIGINT) AS rows FROM k GROUP BY 1", _KEYED))
def str1(spark, sf):
    """The rows of the mirror arrive day by day; a copy in the order of days is all that is written of it."""
    rows, base = mirror_rows(spark, sf), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def start(stream):
        return deduplicated_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()

    replay(rows, base, start)
    d = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return with_natural_key(d).groupBy(F.concat_ws("|", *KEY_COLUMNS).alias("natural_key")).agg(F.count("*").alias("rows"))


@query("STR4_windowed_market_stream", sql("""
SELECT strftime(day, '%Y-%m-%d') AS day, hotel_id, CAST(count(*) AS BIGINT) AS observations, round(min(nightly), 4) AS low, round(max(nightly), 4) AS high
FROM official GROUP BY ALL""", SQL_PRICED))
def str4(spark, sf):
    out = drain(spark, windowed_market(observation_stream(spark, sf)), "update")
    last = out.groupBy("window_start", "hotel_id").agg(F.max_by(F.struct("observations", "low", "high"), "epoch").alias("s"))
    return last.select(day("window_start").alias("day"), "hotel_id", "s.observations", r("s.low", 4).alias("low"), r("s.high", 4).alias("high"))


@query("STR4_median_stream", sql("""
SELECT strftime(day, '%Y-%m-%d') AS day, hotel_id, CAST(count(*) AS BIGINT) AS observations, round(median(nightly), 4) AS median_twd FROM official GROUP BY ALL""", SQL_PRICED))
def str4m(spark, sf):
    """Four micro-batches that each touch every day and hotel."""
    d = observations(spark, sf)
    part = F.pmod(F.xxhash64("observation_id"), F.lit(4))
    parts = [d.where(part == i) for i in range(4)]
    out = rocksdb(spark, lambda: newest_output(spark, parts, lambda s: median_stream(s, late="90 days"), ["hotel_id", "window_start"]))
    return out.select(day("window_start").alias("day"), "hotel_id", "observations", r("median_twd", 4).alias("median_twd"))


@query("STR4_sliding_week", sql("""
, w AS (SELECT hotel_id, nightly, unnest(generate_series(day - INTERVAL 6 DAY, CAST(day AS TIMESTAMP), INTERVAL 1 DAY)) AS ws FROM official)
SELECT strftime(ws, '%Y-%m-%d') AS window_start, hotel_id, CAST(count(*) AS BIGINT) AS observations, round(min(nightly), 4) AS low, round(max(nightly), 4) AS high FROM w GROUP BY ALL""", SQL_PRICED))
def str4b(spark, sf):
    d = windowed_market(observations(spark, sf), "7 days", "1 day")
    return d.select(day("window_start").alias("window_start"), "hotel_id", "observations", r("low", 4).alias("low"), r("high", 4).alias("high"))


@query("STR5_collection_sessions", """
WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS hotel_id, event_type AS source_platform, ts FROM events),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS start FROM e WINDOW w AS (PARTITION BY hotel_id, source_platform ORDER BY ts)),
g AS (SELECT *, sum(start) OVER (PARTITION BY hotel_id, source_platform ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT source_platform, hotel_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(count(*) AS BIGINT) AS observations FROM g GROUP BY source_platform, hotel_id, s""")
def str5(spark, sf):
    d = table(spark, sf, "events").select(
        (F.col("user_id") % 20).cast("string").alias("hotel_id"), F.col("event_type").alias("source_platform"),
        F.col("ts").cast("timestamp").alias("queried_at"), F.lit(None).cast("string").alias("run_id"),
    )
    return collection_sessions(d, "12 hours").select("source_platform", "hotel_id", ts("session_start").alias("session_start"), "observations")


@query("STR5_session_stream", """
WITH e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS hotel_id, 'web' AS source_platform, ts FROM events),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM e WINDOW w AS (PARTITION BY hotel_id ORDER BY ts)),
g AS (SELECT *, sum(start) OVER (PARTITION BY hotel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT hotel_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, CAST(count(*) AS BIGINT) AS observations
FROM g GROUP BY hotel_id, s""")
def str5s(spark, sf):
    """Three micro-batches of interleaved rows, and a last one that ends all sessions."""
    d = table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("string").alias("hotel_id"), F.lit("web").alias("source_platform"), F.col("ts").cast("timestamp").alias("queried_at"),
        F.lit(None).cast("string").alias("run_id"), "event_id",
    )
    end = d.agg(F.max("queried_at").alias("t")).select(F.lit("end").alias("hotel_id"), F.lit("web").alias("source_platform"), (F.col("t") + F.expr("INTERVAL 400 DAYS")).alias("queried_at"), F.lit(None).cast("string").alias("run_id"), F.lit(-1).cast("long").alias("event_id"))
    parts = [d.where(F.col("event_id") % 3 == i).withColumn("event_id", F.col("event_id").cast("long")) for i in range(3)]

    def start(stream, base):
        return session_stream(stream, "30 minutes", late="300 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()

    out = spark.read.parquet(f"{in_batches(spark, [*parts, end], start)}/out")
    return out.where("hotel_id <> 'end'").select("hotel_id", ts("session_start").alias("session_start"), ts("session_end").alias("session_end"), "observations")


@query("STR6_late_stream", sql("""
, m AS (SELECT max(queried_at) AS mark FROM rates WHERE lead_days <> 7),
k2 AS (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY queried_at DESC, observation_id DESC, total_price DESC) AS rn FROM k),
m2 AS (SELECT max(queried_at) AS mark FROM rates WHERE lead_days > 30 OR observation_id = (SELECT observation_id FROM rates WHERE lead_days <> 7 ORDER BY queried_at DESC, observation_id LIMIT 1)),
late AS (SELECT strftime(queried_at, '%Y-%m-%d') AS day, count_if(lead_days < 60 AND queried_at < CASE WHEN lead_days = 7 THEN m.mark ELSE m2.mark END - INTERVAL 1 DAY) AS n FROM rates, m, m2 GROUP BY 1)
SELECT observation_id, strftime(queried_at, '%Y-%m-%d %H:%M:%S') AS queried_at, CAST(n AS BIGINT) AS late_rows_of_day FROM k2 JOIN late ON day = strftime(queried_at, '%Y-%m-%d') WHERE rn = 1""", _KEYED))
def str6s(spark, sf):
    """The newest time comes first; most rows of the later micro-batches are late for it."""
    d = rates(spark, sf)
    parts = [d.where("lead_days > 30"), d.where("lead_days in (1, 14, 30)"), d.where("lead_days = 7")]
    newest = d.where("lead_days <> 7").orderBy(F.col("queried_at").desc(), "observation_id").limit(1)
    parts[0] = parts[0].unionByName(newest)  # again among its own part: the same natural key
    base = in_batches(spark, parts, lambda stream, base: start_latest(stream, f"{base}/latest", f"{base}/state"))
    days = latest_days(spark, f"{base}/latest").select("day", F.col("late_rows").alias("late_rows_of_day"))
    rows = read_latest(spark, f"{base}/latest", d).select("observation_id", ts("queried_at").alias("queried_at"), day("queried_at").alias("day"))
    return rows.join(days, "day").drop("day")


@query("STR6_late_rows", sql("""
SELECT queried_at < (SELECT max(queried_at) FROM rates) - INTERVAL 1 DAY AS late, CAST(count(*) AS BIGINT) AS rows FROM rates GROUP BY 1"""))
def str6(spark, sf):
    d = observations(spark, sf)
    on_time, late = split_late(d, d.agg(F.max("queried_at")).scalar())
    return on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).groupBy("late").agg(F.count("*").alias("rows"))
