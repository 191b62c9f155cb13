"""DQ1-DQ9, J10, W3-W5, T2: warnings, completeness, gaps and reviews."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ratelens.functions.cancellation import with_policy_terms
from ratelens.functions.pricing import verified_market
from ratelens.operators import quality
from ratelens.operators.parity import with_comparison
from registered.book import day, query, r, ts
from registered.scalars import TERMS, policies
from registered.view import SQL_PRICED, observations, sql


@query("DQ1_volume_and_price_warnings", sql("""
, d AS (SELECT *, (SELECT max(day) FROM official) AS top FROM official WHERE NOT (hotel_id IN ('hotel_4', 'hotel_5') AND lead_days <> 7 AND day = (SELECT max(day) FROM official))),
hd AS (SELECT hotel_id, top, day, count(*) AS n, median(CASE WHEN hotel_id IN ('hotel_8', 'hotel_9') AND day = top THEN nightly * 3 ELSE nightly END) AS adr FROM d WHERE day >= top - 7 GROUP BY ALL),
h AS (SELECT hotel_id, coalesce(max(n) FILTER (day = top), 0) AS cur_n, avg(n) FILTER (day < top) AS base_n, max(adr) FILTER (day = top) AS cur, max(adr) FILTER (day = top - 1) AS prev FROM hd GROUP BY 1)
SELECT hotel_id, 'low_volume' AS code, CAST(cur_n AS BIGINT) AS current_count, round(base_n, 4) AS baseline_count, round((cur - prev) / prev, 6) AS change_pct FROM h WHERE cur_n < base_n * 0.5
UNION ALL SELECT hotel_id, 'price_spike', CAST(cur_n AS BIGINT), round(base_n, 4), round((cur - prev) / prev, 6) FROM h WHERE abs((cur - prev) / prev) > 0.5""", SQL_PRICED))
def dq1(spark, sf):
    d = observations(spark, sf).withColumn("day", F.to_date("queried_at"))
    last = F.col("day") == d.where(verified_market()).agg(F.max("day")).scalar()
    thin = F.col("hotel_id").isin("hotel_4", "hotel_5") & (F.col("lead_days") != 7) & last
    dear = F.col("hotel_id").isin("hotel_8", "hotel_9") & last
    d = d.withColumn("source_platform", F.when(thin, "other").otherwise(F.col("source_platform"))).withColumn("nightly_adr_twd", F.when(dear, F.col("nightly_adr_twd") * 3).otherwise(F.col("nightly_adr_twd")))
    return quality.volume_warnings(d.drop("day")).select(
        "hotel_id", "code", "current_count", r("baseline_count", 4).alias("baseline_count"), r("change_pct").alias("change_pct")
    )


@query("W3_W4_daily_volume_frames", sql("""
, hd AS (SELECT hotel_id, day, count(*) AS n, median(nightly) AS adr FROM official WHERE NOT (lead_days > 7 AND day(day) % 3 = 0 AND hotel_id = 'hotel_1') GROUP BY ALL)
SELECT hotel_id, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, round(avg(n) OVER w7, 6) AS baseline_count,
       round(max(adr) OVER (PARTITION BY hotel_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 4) AS yesterday_adr
FROM hd WINDOW w7 AS (PARTITION BY hotel_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""", SQL_PRICED))
def w3(spark, sf):
    gap = (F.col("lead_days") > 7) & (F.dayofmonth("queried_at") % 3 == 0) & (F.col("hotel_id") == "hotel_1")
    d = observations(spark, sf)
    d = quality.daily_volume(d.withColumn("source_platform", F.when(gap, "other").otherwise(F.col("source_platform"))))
    return d.select("hotel_id", day("day").alias("day"), "n", r("baseline_count").alias("baseline_count"), r("yesterday_adr", 4).alias("yesterday_adr"))


@query("DQ2_completeness", sql("""
, t AS (SELECT terms.*, room_size_sqm > 0 AS k_size, tax_state <> 'unknown' AS k_tax, trim(coalesce(cancellation_policy, '')) <> '' AS k_policy FROM terms)
SELECT CASE WHEN grouping(source_platform) = 1 AND grouping(hotel_id) = 1 THEN 'all' WHEN grouping(hotel_id) = 1 THEN 'source' ELSE 'hotel' END AS grain,
  source_platform, hotel_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT t.hotel_id) AS BIGINT) AS hotels,
  strftime(min(queried_at), '%Y-%m-%d %H:%M:%S') AS queried_at_min, strftime(max(queried_at), '%Y-%m-%d %H:%M:%S') AS queried_at_max,
  CAST(count_if(k_size) AS BIGINT) AS known_room_size_rows, CAST(count_if(k_tax) AS BIGINT) AS known_tax_rows, CAST(count_if(k_policy) AS BIGINT) AS known_cancellation_policy_rows,
  CAST(count(nightly) AS BIGINT) AS nightly_adr_rows, CAST(count(*) - count_if(k_size) AS BIGINT) AS unknown_room_size_rows, CAST(count(*) - count_if(k_tax) AS BIGINT) AS unknown_tax_rows
FROM t GROUP BY GROUPING SETS ((), (source_platform), (hotel_id))""", SQL_PRICED, TERMS))
def dq2(spark, sf):
    d = quality.completeness(observations(spark, sf))
    return d.withColumns({"queried_at_min": ts("queried_at_min"), "queried_at_max": ts("queried_at_max")})


@query("DQ3_terms_coverage", sql("""
SELECT source_platform, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(cancellation_class <> 'unknown') AS BIGINT) AS known_cancellation_class_rows,
  CAST(count_if(cancellation_deadline <> 'unknown') AS BIGINT) AS known_cancellation_deadline_rows, CAST(0 AS BIGINT) AS known_cancellation_schedule_rows,
  round(count_if(cancellation_class <> 'unknown') * 1.0 / count(*), 6) AS known_cancellation_class_ratio,
  round(count_if(cancellation_deadline <> 'unknown') * 1.0 / count(*), 6) AS known_cancellation_deadline_ratio, CAST(0 AS DOUBLE) AS known_cancellation_schedule_ratio
FROM terms GROUP BY 1""", SQL_PRICED, TERMS))
def dq3(spark, sf):
    return quality.terms_coverage(observations(spark, sf))


_MISSING = """
miss AS (SELECT *, list_filter([CASE WHEN size_band = 'unknown' THEN 'room_size' END, CASE WHEN breakfast_included IS NULL THEN 'breakfast_included' END,
    CASE WHEN cancellation_class = 'unknown' THEN 'cancellation_class' END, CASE WHEN cancellation_deadline = 'unknown' THEN 'cancellation_deadline' END,
    CASE WHEN tax_state = 'unknown' THEN 'tax_inclusion' END], lambda x: x IS NOT NULL) AS mf FROM terms)
"""
_FIELDS = """
fields AS (SELECT hotel_id, source_platform, f, count(*) AS n FROM (SELECT hotel_id, source_platform, unnest(mf) AS f FROM {src}) GROUP BY ALL),
gaps AS (SELECT hotel_id, source_platform, string_agg(concat(f, '=', n), ',' ORDER BY n DESC, f) AS missing_fields, string_agg(f, ',' ORDER BY f) AS signature FROM fields GROUP BY ALL),
gap_rows AS (SELECT hotel_id, source_platform, count(*) AS rows, max(queried_at) AS latest FROM {src} WHERE len(mf) > 0 GROUP BY ALL)
"""


def keyed(spark, sf):
    return with_comparison(observations(spark, sf))


@query("DQ4_readiness", sql("""
SELECT source_platform, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(len(mf) = 0) AS BIGINT) AS strict_metadata_ready_rows, round(count_if(len(mf) = 0) * 1.0 / count(*), 6) AS strict_metadata_ready_ratio
FROM miss GROUP BY GROUPING SETS ((), (source_platform))""", SQL_PRICED, TERMS, _MISSING))
def dq4(spark, sf):
    return quality.readiness(keyed(spark, sf))


@query("DQ4_missing_field_counts", sql("""
SELECT source_platform, f AS field, CAST(count(*) AS BIGINT) AS rows FROM (SELECT source_platform, unnest(mf) AS f FROM miss) GROUP BY ALL""", SQL_PRICED, TERMS, _MISSING))
def dq4b(spark, sf):
    return quality.missing_field_counts(keyed(spark, sf), ["source_platform"])


def _flat(d):
    return d.withColumns({"missing_fields": F.array_join("missing_fields", ","), "signature": F.array_join("signature", ",")})


@query("DQ4_metadata_gaps", sql("""
SELECT hotel_id, source_platform, CAST(rows AS BIGINT) AS rows, missing_fields, signature FROM gap_rows JOIN gaps USING (hotel_id, source_platform)""", SQL_PRICED, TERMS, _MISSING, _FIELDS.format(src="miss")))
def dq4c(spark, sf):
    return _flat(quality.metadata_gaps(keyed(spark, sf)))


_LATEST = """
newest AS (SELECT source_platform AS s, hotel_id AS h, max(queried_at) AS top, arg_max(coalesce(run_id, ''), (queried_at, observation_id, total_price)) AS top_run FROM miss GROUP BY ALL),
latest AS (SELECT miss.* FROM miss JOIN newest ON source_platform = s AND hotel_id = h WHERE CASE WHEN top_run <> '' THEN run_id = top_run ELSE queried_at >= top - INTERVAL 30 MINUTE END)
"""


@query("DQ5_latest_metadata_gaps", sql("""
SELECT hotel_id, source_platform, CAST(rows AS BIGINT) AS rows, strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_queried_at, missing_fields, signature
FROM gap_rows JOIN gaps USING (hotel_id, source_platform)""", SQL_PRICED, TERMS, _MISSING, _LATEST, _FIELDS.format(src="latest")))
def dq5(spark, sf):
    return _flat(quality.latest_metadata_gaps(keyed(spark, sf))).withColumn("latest_queried_at", ts("latest_queried_at"))


def _policy_rows(spark, sf):
    """Observations with the richer policy texts."""
    d = policies(spark, sf).select(
        F.concat(F.lit("hotel_"), F.col("l_suppkey") % 31).alias("hotel_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("booking_com")).otherwise(F.lit("official")).alias("source_platform"),
        "check_in", "cancellation_policy",
    )
    return with_policy_terms(d)


_P = """
WITH p AS (SELECT concat('hotel_', l_suppkey % 31) AS hotel_id, CASE WHEN l_linenumber % 2 = 0 THEN 'booking_com' ELSE 'official' END AS source_platform, l_partkey % 24 AS k FROM lineitem)
"""
_TEXT = """CASE k WHEN 13 THEN 'Fee � applies' WHEN 22 THEN 'Cancellation policy is available on the official booking page' ELSE '將收取取消費用' END"""
_WHY = "CASE k WHEN 13 THEN 'encoding_corruption' WHEN 22 THEN 'generic_placeholder' ELSE 'generic_fee_notice' END"


@query("DQ6_unknown_policies", _P + f"""
SELECT hotel_id, source_platform, {_TEXT} AS cancellation_policy, CAST(count(*) AS BIGINT) AS rows, {_WHY} AS reason
FROM p WHERE k IN (13, 22, 23) GROUP BY ALL""")
def dq6(spark, sf):
    return quality.unknown_policies(_policy_rows(spark, sf))


@query("T2_blockers_ranked", _P + f"""
SELECT {_WHY} AS reason, hotel_id, source_platform, CAST(count(*) AS BIGINT) AS rows FROM p WHERE k IN (13, 22, 23) GROUP BY ALL ORDER BY rows DESC, reason, hotel_id, source_platform LIMIT 25""")
def dq6b(spark, sf):
    return quality.ranked(quality.blocker_counts(_policy_rows(spark, sf)), "reason", "hotel_id", "source_platform", limit=25)


@query("DQ6_structured_schedules", _P + """
SELECT hotel_id, source_platform, '13~4天前收取訂金30%，3-1日前收取訂金70%，當天收取訂金100%' AS cancellation_policy,
  '[{"days_before_from":13,"days_before_to":4,"penalty_percent":30,"penalty_basis":"deposit"},{"days_before_from":3,"days_before_to":1,"penalty_percent":70,"penalty_basis":"deposit"},{"days_before_from":0,"days_before_to":0,"penalty_percent":100,"penalty_basis":"deposit"}]' AS schedule,
  CAST(count(*) AS BIGINT) AS rows
FROM p WHERE k = 15 GROUP BY ALL""")
def dq6c(spark, sf):
    return quality.structured_schedules(_policy_rows(spark, sf))


@query("DQ6_unresolved_totals", _P + """
SELECT CAST((SELECT count(*) FROM p WHERE k IN (13, 22, 23)) AS BIGINT) AS unresolved_cancellation_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT hotel_id, source_platform, k FROM p WHERE k IN (13, 22, 23))) AS BIGINT) AS unresolved_cancellation_groups""")
def dq6d(spark, sf):
    return quality.unresolved_totals(_policy_rows(spark, sf))


def _reviews(gaps):
    """Reviews of the gaps of five hotels as they are now, one of them outdated."""
    mine = gaps.where(F.col("hotel_id").isin("hotel_1", "hotel_2", "hotel_3", "hotel_10", "hotel_11"))
    fields = F.when(F.col("hotel_id") == "hotel_3", F.array(F.lit("occupancy"))).otherwise(F.reverse("signature"))
    return mine.select(
        "hotel_id", "source_platform", fields.alias("missing_fields"), F.lit("blocked_source_shell").alias("status"), F.lit("2026-09-30").alias("reviewed_at"),
        F.array(F.lit("https://example.test")).alias("evidence_urls"), F.lit("checked").alias("note"),
    )


@query("DQ7_review_outcome", sql("""
SELECT hotel_id, source_platform, CASE WHEN hotel_id IN ('hotel_1', 'hotel_2', 'hotel_10', 'hotel_11') THEN 'reviewed' ELSE 'actionable' END AS disposition, CAST(rows AS BIGINT) AS rows
FROM gap_rows""", SQL_PRICED, TERMS, _MISSING, _FIELDS.format(src="miss")))
def dq7(spark, sf):
    g = quality.metadata_gaps(keyed(spark, sf))
    return quality.review_outcome(g, _reviews(g)).select("hotel_id", "source_platform", "disposition", "rows")


@query("J10_stale_reviews", sql("SELECT hotel_id, source_platform FROM gap_rows WHERE hotel_id = 'hotel_3'", SQL_PRICED, TERMS, _MISSING, _FIELDS.format(src="miss")))
def j10(spark, sf):
    k = keyed(spark, sf)
    g = quality.metadata_gaps(k)
    return quality.stale_reviews(_reviews(g), g, quality.latest_metadata_gaps(k)).select("hotel_id", "source_platform")


@query("DQ7_reviewed_gaps", sql("""
SELECT hotel_id, source_platform, 'history' AS scope, 'blocked_source_shell' AS review_status FROM gap_rows WHERE hotel_id IN ('hotel_1', 'hotel_2', 'hotel_10', 'hotel_11')""", SQL_PRICED, TERMS, _MISSING, _FIELDS.format(src="miss")))
def dq7b(spark, sf):
    k = keyed(spark, sf)
    g = quality.metadata_gaps(k)
    return quality.reviewed_gaps(g, quality.latest_metadata_gaps(k), _reviews(g)).select("hotel_id", "source_platform", "scope", "review_status")


@query("DQ9_top_tax_gaps", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(tax_state <> 'unknown') AS BIGINT) AS known_tax_rows, CAST(count_if(tax_state = 'unknown') AS BIGINT) AS unknown_tax_rows
FROM terms GROUP BY 1 HAVING count_if(tax_state = 'unknown') > 0 ORDER BY unknown_tax_rows DESC, hotel_id LIMIT 10""", SQL_PRICED, TERMS))
def dq9(spark, sf):
    return quality.top_tax_gaps(quality.completeness(observations(spark, sf)))


@query("T3_top_metadata_gaps", sql("""
SELECT hotel_id, source_platform, CAST(rows AS BIGINT) AS rows, missing_fields FROM gap_rows JOIN gaps USING (hotel_id, source_platform) ORDER BY rows DESC, hotel_id, source_platform LIMIT 25""",
    SQL_PRICED, TERMS, _MISSING, _FIELDS.format(src="miss")))
def t3(spark, sf):
    d = quality.ranked(quality.metadata_gaps(keyed(spark, sf)), "hotel_id", "source_platform", limit=25)
    return _flat(d).select("hotel_id", "source_platform", "rows", "missing_fields")


@query("W5_top_days_per_hotel", sql("""
, hd AS (SELECT hotel_id, day, count(*) AS n FROM official GROUP BY ALL)
SELECT hotel_id, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY hotel_id ORDER BY n DESC, day) AS INTEGER) AS position FROM hd QUALIFY position <= 3""", SQL_PRICED))
def w5(spark, sf):
    d = observations(spark, sf).where(verified_market()).groupBy("hotel_id", day("queried_at").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("hotel_id").orderBy(F.col("n").desc(), "day")
    return d.withColumn("position", F.row_number().over(w)).where("position <= 3")
