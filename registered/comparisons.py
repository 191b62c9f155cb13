"""KEY2-KEY4, PAR1, J5, AGG9: like-for-like comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import parity
from ratelens.operators.parity import with_comparison
from registered.book import query, r, ts
from registered.markets import PARITY_SQL, _PUB_TERMS
from registered.scalars import KEYED, TERMS
from registered.view import SQL_DEDUP, SQL_PRICED, observations, published, sql

_STABLE = """
stable AS (SELECT *, CASE WHEN room_type_code <> 'R0' THEN concat('rt_', room_type_code) END AS stable_room_type_id FROM terms)
"""


def _with_stable(d):
    return d.withColumn("stable_room_type_id", F.when(F.col("room_type_code") != "R0", F.concat(F.lit("rt_"), "room_type_code")))


@query("KEY2_comparison_key", sql("""
SELECT comparison_key, CAST(count(*) AS BIGINT) AS rows FROM keyed GROUP BY 1""", SQL_PRICED, TERMS, KEYED))
def key2(spark, sf):
    return with_comparison(observations(spark, sf)).groupBy("comparison_key").agg(F.count("*").alias("rows"))


@query("KEY2_stable_room_key", sql("""
SELECT CASE WHEN breakfast_included IS NOT NULL AND size_band <> 'unknown' AND cancellation_class <> 'unknown'
     AND cancellation_deadline <> 'unknown' AND tax_state <> 'unknown' AND stable_room_type_id IS NOT NULL
  THEN concat_ws('|', hotel_id, CAST(check_in AS VARCHAR), CAST(check_out AS VARCHAR), occupancy, stable_room_type_id,
    CASE WHEN breakfast_included THEN 'breakfast' ELSE 'room_only' END, cancellation_class, cancellation_deadline, tax_state) END AS comparison_key,
  CAST(count(*) AS BIGINT) AS rows
FROM stable GROUP BY 1""", SQL_PRICED, TERMS, _STABLE))
def key2b(spark, sf):
    d = with_comparison(_with_stable(observations(spark, sf)), require_stable_room=True)
    return d.groupBy("comparison_key").agg(F.count("*").alias("rows"))


@query("KEY3_missing_fields", sql("""
SELECT concat_ws(',', CASE WHEN size_band = 'unknown' THEN 'room_size' END, CASE WHEN stable_room_type_id IS NULL THEN 'stable_room_type_id' END,
   CASE WHEN breakfast_included IS NULL THEN 'breakfast_included' END, CASE WHEN cancellation_class = 'unknown' THEN 'cancellation_class' END,
   CASE WHEN cancellation_deadline = 'unknown' THEN 'cancellation_deadline' END, CASE WHEN tax_state = 'unknown' THEN 'tax_inclusion' END) AS missing,
  CAST(count(*) AS BIGINT) AS rows
FROM stable GROUP BY 1""", SQL_PRICED, TERMS, _STABLE))
def key3(spark, sf):
    d = with_comparison(_with_stable(observations(spark, sf)), require_stable_room=True)
    return d.groupBy(F.array_join("missing_fields", ",").alias("missing")).agg(F.count("*").alias("rows"))


@query("KEY4_comparison_metadata", sql("""
SELECT CASE WHEN comparison_key IS NULL THEN 'insufficient_product_metadata' ELSE 'comparable' END AS comparison_status, occupancy,
       cancellation_class, tax_state AS tax_inclusion, size_band, CAST(count(*) AS BIGINT) AS rows
FROM keyed GROUP BY ALL""", SQL_PRICED, TERMS, KEYED))
def key4(spark, sf):
    d = with_comparison(observations(spark, sf))
    return d.groupBy("comparison_status", "occupancy", "cancellation_class", "tax_inclusion", "size_band").agg(F.count("*").alias("rows"))


@query("PAR1_rate_parity", sql("""
SELECT comparison_key, source AS ota_source, round(official, 4) AS official_median_twd, round(ota, 4) AS ota_median_twd,
       round((ota - official) / official, 6) AS gap_percent, strftime(off_ts, '%Y-%m-%d %H:%M:%S') AS official_queried_at,
       strftime(ota_ts, '%Y-%m-%d %H:%M:%S') AS ota_queried_at, round(gap_s / 3600.0, 2) AS query_time_gap_hours
FROM pairs""", SQL_PRICED, SQL_DEDUP, _PUB_TERMS, KEYED, PARITY_SQL))
def par1(spark, sf):
    d = parity.rate_parity(with_comparison(published(spark, sf)))
    return d.select(
        "comparison_key", "ota_source", r("official_median_twd", 4).alias("official_median_twd"), r("ota_median_twd", 4).alias("ota_median_twd"),
        r("gap_percent").alias("gap_percent"), ts("official_queried_at").alias("official_queried_at"), ts("ota_queried_at").alias("ota_queried_at"),
        "query_time_gap_hours",
    )


@query("J5_nearest_in_time_pairs", sql("""
SELECT comparison_key, source AS other_source, strftime(ota_ts, '%Y-%m-%d %H:%M:%S') AS other_ts, strftime(off_ts, '%Y-%m-%d %H:%M:%S') AS official_ts,
       round(gap_s / 3600.0, 4) AS gap_hours
FROM pairs""", SQL_PRICED, TERMS, KEYED, PARITY_SQL))
def j5(spark, sf):
    d = with_comparison(observations(spark, sf)).where("comparison_key is not null")
    i = d.select("comparison_key", F.col("source_platform").alias("source"), F.col("queried_at").alias("ts")).distinct()
    return parity.newest_valid_pairs(i, 24 * 3600).select(
        "comparison_key", "other_source", ts("other_ts").alias("other_ts"), ts("official_ts").alias("official_ts"), r("gap_hours", 4).alias("gap_hours")
    )


@query("AGG9_source_comparison", sql("""
, m AS (SELECT comparison_key, source_platform, median(nightly) AS m FROM keyed WHERE comparison_key IS NOT NULL GROUP BY ALL),
g AS (SELECT comparison_key, max(m) FILTER (source_platform = 'official') AS o, min(m) FILTER (source_platform <> 'official') AS l FROM m GROUP BY 1)
SELECT substr(sha256(comparison_key), 1, 16) AS group_id, round(o, 4) AS official_median_twd, round(l, 4) AS lowest_ota_median_twd, round((l - o) / o, 6) AS gap
FROM g WHERE o IS NOT NULL AND l IS NOT NULL""", SQL_PRICED, TERMS, KEYED))
def agg9(spark, sf):
    d = parity.source_comparison(with_comparison(observations(spark, sf)))
    return d.select(
        "group_id", r("official_median_twd", 4).alias("official_median_twd"), r("lowest_ota_median_twd", 4).alias("lowest_ota_median_twd"), r("gap").alias("gap")
    )
