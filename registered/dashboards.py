"""AGG10-AGG15, W5, W10, T6-T8: dashboard aggregations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ratelens.operators import facets
from registered.book import day, query, r, tied, tied_sql
from registered.view import SQL_DEDUP, SQL_PRICED, SQL_TERMS, observations, published, sql, table

_TERMS = SQL_TERMS.replace("{source}", "priced")
_CELLS = """
cells AS (SELECT hotel_id, check_in, median(nightly) AS med, min(nightly) AS low, max(nightly) AS high, count(DISTINCT room_type_name) AS rooms,
            string_agg(DISTINCT CAST(lead_days AS VARCHAR), ',' ORDER BY CAST(lead_days AS VARCHAR)) AS leads
          FROM published GROUP BY ALL),
span AS (SELECT min(med) AS lo, max(med) AS hi FROM cells)
"""


@query("AGG10_price_heatmap", sql("""
SELECT hotel_id, strftime(check_in, '%Y-%m-%d') AS check_in, round(med, 4) AS median, round(low, 4) AS low, round(high, 4) AS high,
       CAST(rooms AS BIGINT) AS rooms, CAST(len(string_split(leads, ',')) AS INTEGER) AS lead_count, round((med - lo) / (hi - lo), 6) AS ratio,
       CAST(floor(120 * (1 - (med - lo) / (hi - lo)) + 0.5) AS INTEGER) AS hue
FROM cells, span WHERE check_in IN (SELECT DISTINCT check_in FROM published ORDER BY 1 LIMIT 30)""", SQL_PRICED, SQL_DEDUP, _CELLS))
def agg10(spark, sf):
    d = facets.price_heatmap(published(spark, sf))
    return d.select(
        "hotel_id", day("check_in").alias("check_in"), r("median", 4).alias("median"), r("low", 4).alias("low"), r("high", 4).alias("high"),
        "rooms", F.size(F.split("leads", ",")).alias("lead_count"), r("ratio").alias("ratio"), "hue",
    )


@query("T6_first_stay_dates", sql("SELECT strftime(d, '%Y-%m-%d') AS check_in FROM (SELECT DISTINCT check_in AS d FROM rates ORDER BY 1 LIMIT 30)"))
def t6(spark, sf):
    d = observations(spark, sf).select("check_in").distinct().orderBy("check_in").limit(30)
    return d.select(day("check_in").alias("check_in"))


@query("AGG11_stay_trend", sql("SELECT hotel_id, strftime(check_in, '%Y-%m-%d') AS check_in, round(median(nightly), 4) AS median_twd FROM published GROUP BY ALL", SQL_PRICED, SQL_DEDUP))
def agg11a(spark, sf):
    return facets.stay_trend(published(spark, sf)).select("hotel_id", day("check_in").alias("check_in"), r("median_twd", 4).alias("median_twd"))


@query("AGG11_observed_trend", sql(f"""
SELECT hotel_id, strftime(day, '%Y-%m-%d') AS day, {tied_sql('avg(nightly)')} AS average_twd, round(median(nightly), 4) AS median_twd
FROM published GROUP BY ALL""", SQL_PRICED, SQL_DEDUP))
def agg11b(spark, sf):
    d = facets.observed_trend(published(spark, sf))
    return d.select("hotel_id", day("day").alias("day"), tied("average_twd").alias("average_twd"), r("median_twd", 4).alias("median_twd"))


@query("AGG11_booking_curve", sql("SELECT hotel_id, lead_days, round(median(nightly), 4) AS median_twd FROM published GROUP BY ALL", SQL_PRICED, SQL_DEDUP))
def agg11c(spark, sf):
    return facets.booking_curve(published(spark, sf)).select("hotel_id", "lead_days", r("median_twd", 4).alias("median_twd"))


@query("AGG12_room_catalog", sql("""
SELECT room_type_name, round(room_size_sqm, 2) AS room_size_sqm, round(min(nightly), 4) AS low, round(median(nightly), 4) AS median, round(max(nightly), 4) AS high,
       CAST(count(nightly) AS BIGINT) AS observations FROM published GROUP BY room_type_name, room_size_sqm""", SQL_PRICED, SQL_DEDUP))
def agg12a(spark, sf):
    d = facets.room_catalog(published(spark, sf))
    return d.select(
        "room_type_name", r("room_size_sqm", 2).alias("room_size_sqm"), r("low", 4).alias("low"), r("median", 4).alias("median"), r("high", 4).alias("high"), "observations"
    )


@query("AGG12_room_variety", sql("""
SELECT hotel_id, CAST(count(DISTINCT room_type_name) AS BIGINT) AS room_names, CAST(count(DISTINCT room_size_sqm) AS BIGINT) AS area_specs,
       round(count(*) FILTER (room_size_sqm >= 60) * 1.0 / count(*), 6) AS suite_share, CAST(count(*) FILTER (unit IS NULL) AS BIGINT) AS invalid_unit_price
FROM (SELECT * REPLACE (CASE WHEN room_size_sqm = 65 THEN 85 ELSE room_size_sqm END AS room_size_sqm) FROM published) GROUP BY 1""", SQL_PRICED, SQL_DEDUP))
def agg12b(spark, sf):
    d = published(spark, sf)
    d = d.withColumn("room_size_sqm", F.when(F.col("room_size_sqm") == 65, F.lit(85)).otherwise(F.col("room_size_sqm")))
    return facets.room_variety(d).select("hotel_id", "room_names", "area_specs", r("suite_share").alias("suite_share"), "invalid_unit_price")


@query("AGG13_band_facets", sql("""
SELECT size_band AS band, CAST(count(DISTINCT concat_ws('|', hotel_id, room_type_code, coalesce(CAST(room_size_sqm AS VARCHAR), ''))) AS BIGINT) AS room_types
FROM terms GROUP BY 1""", SQL_PRICED, _TERMS))
def agg13a(spark, sf):
    return facets.band_facets(observations(spark, sf))


@query("AGG13_place_facets", sql("""
SELECT city, CAST(count(DISTINCT hotel_id) AS BIGINT) AS hotels, CAST(CASE city WHEN 'Taipei' THEN 0 WHEN 'Taichung' THEN 4 ELSE 5 END AS INTEGER) AS rank
FROM rates GROUP BY 1"""))
def agg13b(spark, sf):
    return facets.place_facets(observations(spark, sf))


@query("T8_places_in_order", sql("""
SELECT city, CAST(row_number() OVER (ORDER BY CASE city WHEN 'Taipei' THEN 0 WHEN 'Taichung' THEN 4 ELSE 5 END, city) AS INTEGER) AS position
FROM (SELECT DISTINCT city FROM rates)"""))
def t8(spark, sf):
    d = facets.place_facets(observations(spark, sf))
    # One row per city.
    return d.select("city", F.row_number().over(Window.orderBy("rank", "city")).alias("position"))


@query("AGG14_service_charge", sql("""
, o AS (SELECT hotel_id, median(service_charge / price_before_tax * 100) FILTER (price_before_tax > 0) AS p FROM priced GROUP BY 1)
SELECT hotel_id, round(CASE WHEN hotel_id IN ('hotel_1', 'hotel_2') THEN 10.0 ELSE p END, 6) AS service_charge_percent,
       CASE WHEN hotel_id IN ('hotel_1', 'hotel_2') THEN 'documented' WHEN p IS NOT NULL THEN 'observed' ELSE 'unknown' END AS provenance
FROM o""", SQL_PRICED))
def agg14(spark, sf):
    d = observations(spark, sf)
    stated = d.select("hotel_id").distinct().where(F.col("hotel_id").isin("hotel_1", "hotel_2")).withColumn("service_charge_percent", F.lit(10.0))
    return facets.service_charge(d, stated).select("hotel_id", r("service_charge_percent").alias("service_charge_percent"), "provenance")


_FRESH = """
f AS (SELECT hotel_id, max(queried_at) AS last_success FROM rates GROUP BY 1),
g AS (SELECT hotel_id, epoch(TIMESTAMP '2026-10-02 12:00:00' - last_success) / 3600 AS age FROM f)
"""


@query("AGG15_freshness", sql("""
SELECT hotel_id, round(age, 4) AS age_hours, CASE WHEN age <= 36 THEN 'fresh' WHEN age <= 72 THEN 'aging' ELSE 'stale' END AS state FROM g""", _FRESH))
def agg15(spark, sf):
    d = facets.freshness(observations(spark, sf), F.lit("2026-10-02 12:00:00").cast("timestamp"))
    return d.select("hotel_id", r("age_hours", 4).alias("age_hours"), "state")


@query("AGG15_scheduled_fresh_ratio", sql("""
, s AS (SELECT DISTINCT concat('hotel_', s_suppkey % 31) AS hotel_id FROM supplier)
SELECT CAST(count_if(age <= 36) AS BIGINT) AS fresh, CAST(count(*) AS BIGINT) AS scheduled, round(count_if(age <= 36) * 1.0 / count(*), 6) AS ratio
FROM s LEFT JOIN g USING (hotel_id)""", _FRESH))
def agg15b(spark, sf):
    fresh = facets.freshness(observations(spark, sf), F.lit("2026-10-02 12:00:00").cast("timestamp"))
    hotels = table(spark, sf, "supplier").select(F.concat(F.lit("hotel_"), F.col("s_suppkey") % 31).alias("hotel_id")).distinct()
    return facets.scheduled_fresh(fresh, hotels.withColumn("enabled", F.lit(True))).select("fresh", "scheduled", r("ratio").alias("ratio"))


@query("W10_global_scale", sql("SELECT round(lo, 4) AS lo, round(hi, 4) AS hi FROM span", SQL_PRICED, SQL_DEDUP, _CELLS))
def w10(spark, sf):
    d = facets.stay_trend(published(spark, sf))
    return d.agg(F.round(F.min("median_twd"), 4).alias("lo"), F.round(F.max("median_twd"), 4).alias("hi"))


@query("T7_detail_preview", sql("""
SELECT observation_id, strftime(queried_at, '%Y-%m-%d %H:%M:%S') AS queried_at FROM rates ORDER BY rates.queried_at DESC, observation_id DESC LIMIT 120"""))
def t7(spark, sf):
    d = observations(spark, sf).orderBy(F.col("queried_at").desc(), F.col("observation_id").desc()).limit(120)
    return d.select("observation_id", F.date_format("queried_at", "yyyy-MM-dd HH:mm:ss").alias("queried_at"))
