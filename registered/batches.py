"""KEY1, DED1-DED2, LAT1-LAT2, J12-J13, J16, W1-W2: keys, dedup and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import dedup, market
from ratelens.operators.dedup import KEY_COLUMNS
from ratelens.sinks import history
from registered.book import query, r, ts
from registered.view import SQL_DEDUP, SQL_PRICED, observations, priced_rates, published, rates, sql

_KEYED = """
k AS (
  SELECT *, concat_ws('|', hotel_id, source_platform, CAST(check_in AS VARCHAR), CAST(check_out AS VARCHAR), rooms, adults, children,
         room_type_code, rate_plan_code, currency, strftime(queried_at, '%Y-%m-%d')) AS natural_key
  FROM rates)
"""


@query("KEY1_natural_key", sql("SELECT natural_key, CAST(count(*) AS BIGINT) AS rows FROM k GROUP BY 1", _KEYED))
def key1(spark, sf):
    d = dedup.with_natural_key(rates(spark, sf))
    return d.groupBy(F.concat_ws("|", *KEY_COLUMNS).alias("natural_key")).agg(F.count("*").alias("rows"))


@query("KEY1_name_fallback", sql("""
SELECT CASE WHEN lead_days = 7 THEN concat('name:', room_type_name) ELSE room_type_code END AS room_part,
       CASE WHEN lead_days = 30 THEN concat('name:', rate_plan_name) ELSE rate_plan_code END AS plan_part,
       CAST(count(*) AS BIGINT) AS rows
FROM rates GROUP BY ALL"""))
def key1b(spark, sf):
    d = rates(spark, sf).withColumns(
        {
            "room_type_code": F.when(F.col("lead_days") != 7, F.col("room_type_code")),
            "rate_plan_code": F.when(F.col("lead_days") == 30, F.lit("")).otherwise(F.col("rate_plan_code")),
        }
    )
    return dedup.with_natural_key(d).groupBy(F.col("key_room").alias("room_part"), F.col("key_plan").alias("plan_part")).agg(F.count("*").alias("rows"))


_RANK = """
SELECT observation_id, strftime(queried_at, '%Y-%m-%d %H:%M:%S') AS queried_at, round(total_price, 4) AS total_price
FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY {order}) AS rn FROM k) WHERE rn = 1
"""


@query("DED1_keep_latest", sql(_RANK.format(order="queried_at DESC, observation_id DESC, total_price DESC"), _KEYED))
def ded1(spark, sf):
    d = dedup.deduplicate(rates(spark, sf))
    return d.select("observation_id", ts("queried_at").alias("queried_at"), r("total_price", 4).alias("total_price"))


@query("DED2_keep_first", sql(_RANK.format(order="queried_at, observation_id, total_price"), _KEYED))
def ded2(spark, sf):
    d = dedup.deduplicate(rates(spark, sf), keep="first")
    return d.select("observation_id", ts("queried_at").alias("queried_at"), r("total_price", 4).alias("total_price"))


@query("SNK14_dedup_counts", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows_before, CAST(count(DISTINCT natural_key) AS BIGINT) AS rows_after
FROM k GROUP BY 1""", _KEYED))
def snk14(spark, sf):
    return dedup.dedup_counts(rates(spark, sf))


_BATCH = """
newest AS (
  SELECT source_platform AS s, hotel_id AS h, max(queried_at) AS top,
         arg_max(coalesce(run_id, ''), (queried_at, observation_id, total_price)) AS top_run
  FROM {src} GROUP BY ALL),
batch AS (
  SELECT {src}.* FROM {src} JOIN newest ON source_platform = s AND hotel_id = h
  WHERE CASE WHEN top_run <> '' THEN run_id = top_run ELSE {legacy} END)
"""
_STRICT = "run_id IS NULL AND queried_at >= top - INTERVAL 30 MINUTE"
_LOOSE = "queried_at >= top - INTERVAL 30 MINUTE"
_OUT = "SELECT observation_id, source_platform, hotel_id, coalesce(run_id, '') AS run_id FROM batch"


def _out(d):
    return d.select("observation_id", "source_platform", "hotel_id", F.coalesce("run_id", F.lit("")).alias("run_id"))


@query("LAT1_latest_batches", sql(_OUT, SQL_PRICED, SQL_DEDUP, _BATCH.format(src="published", legacy=_STRICT)))
def lat1(spark, sf):
    return _out(dedup.latest_batches(published(spark, sf)))


@query("LAT2_latest_batches_loose", sql(_OUT, _BATCH.format(src="rates", legacy=_LOOSE)))
def lat2(spark, sf):
    return _out(dedup.latest_batches(observations(spark, sf), strict_legacy=False))


@query("J13_rows_at_latest_times", sql("""
SELECT hotel_id, source_platform, CAST(count(*) AS BIGINT) AS rows FROM published
WHERE queried_at IN (SELECT queried_at FROM batch) GROUP BY ALL""", SQL_PRICED, SQL_DEDUP, _BATCH.format(src="published", legacy=_STRICT)))
def j13(spark, sf):
    p = published(spark, sf)
    d = market.latest_rows_of_history(p, dedup.latest_batches(p))
    return d.groupBy("hotel_id", "source_platform").agg(F.count("*").alias("rows"))


@query("J16_existing_key_anti_join", sql("""
, old AS (SELECT DISTINCT natural_key FROM k WHERE lead_days <= 14),
fresh AS (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY queried_at, observation_id, total_price) AS rn FROM k)
SELECT observation_id, round(total_price, 4) AS total_price FROM fresh WHERE rn = 1 AND natural_key NOT IN (SELECT natural_key FROM old)""", _KEYED))
def j16(spark, sf):
    d = rates(spark, sf)
    out = history.new_observations(d, d.where("lead_days <= 14"))
    return out.select("observation_id", r("total_price", 4).alias("total_price"))


@query("W1_published_rows", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows, round(sum(nightly), 4) AS nightly_sum FROM published GROUP BY 1""", SQL_PRICED, SQL_DEDUP))
def w1(spark, sf):
    d = published(spark, sf)
    return d.groupBy("hotel_id").agg(F.count("*").alias("rows"), F.round(F.sum("nightly_adr_twd"), 4).alias("nightly_sum"))


@query("W2_newest_run_per_stream", sql("SELECT s AS source_platform, h AS hotel_id, top_run AS run_id FROM newest", SQL_PRICED, _BATCH.format(src="priced", legacy=_STRICT)))
def w2(spark, sf):
    d = priced_rates(spark, sf)
    order = F.struct("queried_at", "observation_id", "total_price")
    return d.groupBy("source_platform", "hotel_id").agg(F.max_by(F.coalesce("run_id", F.lit("")), order).alias("run_id"))
