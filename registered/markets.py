"""AGG1-AGG8, J11, T1, T3, T4, U4: market indicators over published rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions.pricing import verified_market
from ratelens.operators import dedup, market
from ratelens.operators.parity import with_comparison
from ratelens.operators.stats import grouped_stats
from registered.batches import _BATCH, _STRICT
from registered.book import day, query, r, tied, tied_sql, ts
from registered.scalars import KEYED
from registered.view import SQL_DEDUP, SQL_PRICED, SQL_TERMS, observations, published, sql

#: The tables hold no index, so it is made up from the month of the observation.
_CPI_SQL = "nightly * 100 / (100 + month(queried_at))"


def _with_cpi(d):
    return d.withColumn("cpi_adjusted_nightly_twd", F.col("nightly_adr_twd") * 100 / (100 + F.month("queried_at")))


_SUMMARY = f"""
per_hotel AS (SELECT hotel_id, avg(nightly) AS a, median(nightly) AS m, median(unit) AS u, median({_CPI_SQL}) AS c FROM {{src}} WHERE is_official GROUP BY 1)
"""
_SUMMARY_SELECT = """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {src} WHERE is_official) AS observations, CAST(count(*) AS BIGINT) AS hotels,
       round_even(avg(a), 0) AS average_adr_twd, round_even(median(m), 0) AS median_adr_twd, round_even(median(u), 0) AS median_per_sqm_twd,
       round_even(median(c), 0) AS median_cpi_adjusted_twd
FROM per_hotel
"""


@query("AGG1_market_summary", sql(_SUMMARY_SELECT.format(src="priced"), SQL_PRICED, _SUMMARY.format(src="priced")))
def agg1(spark, sf):
    return market.market_summary(_with_cpi(observations(spark, sf)))


@query("AGG2_period_market", sql("""
, h AS (SELECT strftime(day, '%Y-%m-%d') AS day, hotel_id, median(nightly) AS m, count(*) AS n FROM published WHERE is_official GROUP BY ALL)
SELECT day, round(median(m), 4) AS market_median_twd, round(avg(m), 6) AS market_average_twd, CAST(count(*) AS BIGINT) AS hotels,
       CAST(sum(n) AS BIGINT) AS observations FROM h GROUP BY day""", SQL_PRICED, SQL_DEDUP))
def agg2(spark, sf):
    d = published(spark, sf).where(verified_market()).withColumn("day", day("queried_at"))
    return market.period_market(d, "day").select(
        "day", r("market_median_twd", 4).alias("market_median_twd"), r("market_average_twd").alias("market_average_twd"), "hotels", "observations"
    )


_WEEK = """
dated AS (SELECT *, (SELECT max(day) FROM published WHERE is_official) AS top FROM published WHERE is_official),
weeks AS (SELECT *, CASE WHEN day > top - 7 THEN 'current' WHEN day > top - 14 THEN 'previous' END AS period FROM dated WHERE day > top - 14),
wh AS (SELECT period, hotel_id, median(nightly) AS m, count(*) AS n FROM weeks GROUP BY ALL),
wp AS (SELECT period, median(m) AS med, avg(m) AS mean, count(*) AS hotels, sum(n) AS obs FROM wh GROUP BY 1),
movers AS (SELECT c.hotel_id, c.m AS cur, p.m AS prev, (c.m - p.m) / p.m AS change_pct FROM wh c JOIN wh p ON c.hotel_id = p.hotel_id
           WHERE c.period = 'current' AND p.period = 'previous')
"""


@query("AGG3_weekly_digest", sql("""
SELECT true AS available, strftime(c.top - 6, '%Y-%m-%d') AS current_start, strftime(c.top, '%Y-%m-%d') AS current_end,
       strftime(c.top - 13, '%Y-%m-%d') AS previous_start, strftime(c.top - 7, '%Y-%m-%d') AS previous_end,
       round(a.med, 4) AS current_median, round(a.mean, 4) AS current_mean, CAST(a.hotels AS BIGINT) AS current_hotels, CAST(a.obs AS BIGINT) AS current_observations,
       round(b.med, 4) AS previous_median, round(b.mean, 4) AS previous_mean, CAST(b.hotels AS BIGINT) AS previous_hotels, CAST(b.obs AS BIGINT) AS previous_observations,
       round((a.med - b.med) / b.med, 6) AS change_pct, (SELECT CAST(count(*) AS BIGINT) FROM movers WHERE prev <> 0) AS comparable_hotels
FROM (SELECT max(top) AS top FROM dated) c, wp a, wp b WHERE a.period = 'current' AND b.period = 'previous'""", SQL_PRICED, SQL_DEDUP, _WEEK))
def agg3(spark, sf):
    d = market.weekly_digest(published(spark, sf))
    return d.select(
        "available", *[day(f"{p}_{e}").alias(f"{p}_{e}") for p in ("current", "previous") for e in ("start", "end")],
        *[x for p in ("current", "previous") for x in (
            r(f"{p}_market_median_twd", 4).alias(f"{p}_median"), r(f"{p}_market_average_twd", 4).alias(f"{p}_mean"),
            F.col(f"{p}_hotels"), F.col(f"{p}_observations"))],
        r("change_pct").alias("change_pct"), "comparable_hotels",
    )


@query("T1_top_movers", sql("""
SELECT hotel_id, round(cur, 4) AS current_median_twd, round(prev, 4) AS previous_median_twd, round(change_pct, 6) AS change_pct
FROM movers ORDER BY abs(change_pct) DESC, hotel_id LIMIT 5""", SQL_PRICED, SQL_DEDUP, _WEEK))
def t1(spark, sf):
    return market.weekly_movers(published(spark, sf)).select(
        "hotel_id", r("current_median_twd", 4).alias("current_median_twd"), r("previous_median_twd", 4).alias("previous_median_twd"), r("change_pct").alias("change_pct")
    )


@query("J11_hotels_in_both_weeks", sql("""
SELECT hotel_id, concat('Hotel ', substr(hotel_id, 7)) AS hotel_name, round(change_pct, 6) AS change_pct FROM movers""", SQL_PRICED, SQL_DEDUP, _WEEK))
def j11(spark, sf):
    return market.weekly_movers(published(spark, sf), limit=None).select("hotel_id", "hotel_name", r("change_pct").alias("change_pct"))


@query("AGG3_lead_time_curve", sql("""
, l AS (SELECT lead_days, hotel_id, median(nightly) AS m FROM weeks WHERE period = 'current' GROUP BY ALL)
SELECT lead_days, round(median(m), 4) AS market_median_twd, CAST(count(*) AS BIGINT) AS hotels FROM l GROUP BY 1""", SQL_PRICED, SQL_DEDUP, _WEEK))
def agg3c(spark, sf):
    return market.lead_time_curve(published(spark, sf)).select("lead_days", r("market_median_twd", 4).alias("market_median_twd"), "hotels")


@query("AGG4_equal_weight_median", sql("""
, h AS (SELECT city, is_core AS core, hotel_id, median(nightly) AS m FROM published WHERE is_official GROUP BY ALL),
h2 AS (SELECT city, hotel_id, median(nightly) AS m FROM published WHERE is_official GROUP BY ALL)
SELECT city, 'core' AS scope, round(median(m), 4) AS median_twd, CAST(count(*) AS BIGINT) AS hotels FROM h WHERE core GROUP BY city
UNION ALL SELECT city, 'all', round(median(m), 4), CAST(count(*) AS BIGINT) FROM h2 GROUP BY city""", SQL_PRICED, SQL_DEDUP))
def agg4(spark, sf):
    d = published(spark, sf).where(verified_market())
    core = market.equal_weight_median(d, ["city"], core_only=True).withColumn("scope", F.lit("core"))
    every = market.equal_weight_median(d, ["city"]).withColumn("scope", F.lit("all"))
    return core.unionByName(every).select("city", "scope", r("median_twd", 4).alias("median_twd"), "hotels")


_SIDES = """
sided AS (SELECT *, CASE WHEN day = top THEN 'current' WHEN day = top - 7 THEN 'previous' END AS side FROM dated WHERE day IN (top, top - 7)),
fwd AS (SELECT side, hotel_id, median(nightly) AS m FROM sided WHERE check_in BETWEEN top AND top + 30 GROUP BY ALL),
dm AS (SELECT c.hotel_id, c.m AS cur, p.m AS prev, (c.m - p.m) / p.m AS change_pct FROM fwd c JOIN fwd p ON c.hotel_id = p.hotel_id
       WHERE c.side = 'current' AND p.side = 'previous')
"""


@query("AGG5_forward_medians", sql("SELECT side, hotel_id, round(m, 4) AS median_twd FROM fwd", SQL_PRICED, SQL_DEDUP, _WEEK, _SIDES))
def agg5(spark, sf):
    return market.forward_medians(published(spark, sf)).select("side", "hotel_id", r("median_twd", 4).alias("median_twd"))


@query("AGG6_daily_movers", sql("SELECT hotel_id, round(cur, 4) AS cur, round(prev, 4) AS prev, round(change_pct, 6) AS change_pct FROM dm", SQL_PRICED, SQL_DEDUP, _WEEK, _SIDES))
def agg6m(spark, sf):
    return market.daily_movers(published(spark, sf)).select(
        "hotel_id", r("current_median_twd", 4).alias("cur"), r("previous_median_twd", 4).alias("prev"), r("change_pct").alias("change_pct")
    )


PARITY_SQL = """
instants AS (SELECT comparison_key, source_platform AS source, queried_at AS ts, median(nightly) AS m FROM keyed WHERE comparison_key IS NOT NULL GROUP BY ALL),
cand AS (SELECT o.comparison_key, o.source, o.ts AS ota_ts, o.m AS ota, f.ts AS off_ts, f.m AS official,
                abs(epoch(o.ts) - epoch(f.ts)) AS gap_s
         FROM instants o JOIN instants f ON o.comparison_key = f.comparison_key AND f.source = 'official' AND o.source <> 'official'
          AND abs(epoch(o.ts) - epoch(f.ts)) <= 86400),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comparison_key, source ORDER BY ota_ts DESC, gap_s, off_ts DESC) AS rn FROM cand) WHERE rn = 1)
"""
_PUB_TERMS = SQL_TERMS.replace("{source}", "published")


@query("AGG6_daily_digest", sql("""
, core AS (SELECT side, median(m) AS m FROM (SELECT side, hotel_id, median(nightly) AS m FROM sided WHERE is_core GROUP BY ALL) GROUP BY 1)
SELECT strftime((SELECT max(top) FROM dated), '%Y-%m-%d') AS latest_date,
  round(((SELECT m FROM core WHERE side = 'current') - (SELECT m FROM core WHERE side = 'previous')) / (SELECT m FROM core WHERE side = 'previous'), 6) AS core_adr_change_pct,
  (SELECT hotel_id FROM dm ORDER BY change_pct DESC, hotel_id DESC LIMIT 1) AS largest_increase_hotel,
  round((SELECT max(change_pct) FROM dm), 6) AS largest_increase_pct,
  (SELECT hotel_id FROM dm ORDER BY change_pct, hotel_id LIMIT 1) AS largest_decrease_hotel,
  round((SELECT min(change_pct) FROM dm), 6) AS largest_decrease_pct,
  (SELECT CAST(count(*) AS BIGINT) FROM pairs) AS parity_products,
  round((SELECT avg(CASE WHEN abs((ota - official) / official) <= 0.05 THEN 1.0 ELSE 0.0 END) FROM pairs), 6) AS parity_normal_rate""",
    SQL_PRICED, SQL_DEDUP, _WEEK, _SIDES, _PUB_TERMS, KEYED, PARITY_SQL))
def agg6(spark, sf):
    p = published(spark, sf)
    return market.daily_digest(p, with_comparison(p)).select(
        day("latest_date").alias("latest_date"), r("core_adr_change_pct").alias("core_adr_change_pct"), "largest_increase_hotel",
        r("largest_increase_pct").alias("largest_increase_pct"), "largest_decrease_hotel", r("largest_decrease_pct").alias("largest_decrease_pct"),
        "parity_products", r("parity_normal_rate").alias("parity_normal_rate"),
    )


_ROLL = f"""
SELECT {{keys}} hotel_id, city, CAST(count(nightly) AS BIGINT) AS observations, {tied_sql('avg(nightly)')} AS average_twd, round(median(nightly), 4) AS median_twd,
       round(median(CASE WHEN is_core THEN nightly END), 4) AS core_median_twd, round(median(unit), 6) AS median_per_sqm_twd{{extra}}
FROM published WHERE is_official GROUP BY ALL
"""


def _roll(d, *keys):
    return d.select(
        *keys, "hotel_id", "city", "observations", tied("average_twd").alias("average_twd"), r("median_twd", 4).alias("median_twd"),
        r("core_median_twd", 4).alias("core_median_twd"), r("median_per_sqm_twd").alias("median_per_sqm_twd"),
    )


@query("AGG7_daily_rollup", sql(_ROLL.format(keys="strftime(day, '%Y-%m-%d') AS queried_date,", extra=""), SQL_PRICED, SQL_DEDUP))
def agg7a(spark, sf):
    return _roll(market.history_rollup(published(spark, sf), "daily"), day("day").alias("queried_date"))


@query("AGG7_hotel_rollup", sql(_ROLL.format(keys="", extra=", CAST(count(DISTINCT day) AS BIGINT) AS days"), SQL_PRICED, SQL_DEDUP))
def agg7b(spark, sf):
    return _roll(market.history_rollup(published(spark, sf), "hotel"), "days")


@query("AGG7_lead_rollup", sql(_ROLL.format(keys="lead_days,", extra=""), SQL_PRICED, SQL_DEDUP))
def agg7c(spark, sf):
    return _roll(market.history_rollup(published(spark, sf), "lead"), "lead_days")


_GRAIN = f"""
SELECT '{{grain}}' AS grain, {{day}} AS queried_date, {{lead}} AS lead_days, hotel_id, city, CAST(count(nightly) AS BIGINT) AS observations, {tied_sql('avg(nightly)')} AS average_twd,
       round(median(nightly), 4) AS median_twd, round(median(CASE WHEN is_core THEN nightly END), 4) AS core_median_twd, round(median(unit), 6) AS median_per_sqm_twd, {{days}} AS days
FROM published WHERE is_official GROUP BY ALL
"""
_NO_DAY, _NO_LEAD, _NO_DAYS = "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)", "CAST(NULL AS BIGINT)"


@query("AGG7_history_rollups", sql("UNION ALL".join([
    _GRAIN.format(grain="daily", day="strftime(day, '%Y-%m-%d')", lead=_NO_LEAD, days=_NO_DAYS),
    _GRAIN.format(grain="hotel", day=_NO_DAY, lead=_NO_LEAD, days="CAST(count(DISTINCT day) AS BIGINT)"),
    _GRAIN.format(grain="lead", day=_NO_DAY, lead="lead_days", days=_NO_DAYS),
]), SQL_PRICED, SQL_DEDUP))
def agg7d(spark, sf):
    return _roll(market.history_rollups(published(spark, sf)), "grain", day("day").alias("queried_date"), "lead_days", "days")


@query("AGG8_latest_summary", sql(f"""
, official_latest AS (SELECT * FROM published WHERE is_official AND queried_at IN (SELECT queried_at FROM batch)),
ph AS (SELECT hotel_id, avg(nightly) AS a, median(nightly) AS m, median(unit) AS u, median({_CPI_SQL}) AS c FROM official_latest GROUP BY 1)
SELECT (SELECT strftime(max(queried_at), '%Y-%m-%d %H:%M:%S') FROM batch) AS latest_queried_at, (SELECT CAST(count(*) AS BIGINT) FROM batch) AS record_count,
       (SELECT CAST(count(DISTINCT hotel_id) AS BIGINT) FROM batch) AS hotel_count,
       (SELECT CAST(count(DISTINCT concat(hotel_id, room_type_code)) AS BIGINT) FROM batch) AS room_type_count,
       (SELECT CAST(count(*) AS BIGINT) FROM official_latest) AS observations, CAST(count(*) AS BIGINT) AS hotels,
       round_even(avg(a), 0) AS average_adr_twd, round_even(median(m), 0) AS median_adr_twd, round_even(median(u), 0) AS median_per_sqm_twd,
       round_even(median(c), 0) AS median_cpi_adjusted_twd
FROM ph""", SQL_PRICED, SQL_DEDUP, _BATCH.format(src="published", legacy=_STRICT)))
def agg8(spark, sf):
    p = _with_cpi(published(spark, sf))
    return market.latest_summary(dedup.latest_batches(p), p).withColumn("latest_queried_at", ts("latest_queried_at"))


@query("T4_null_first_ordering", sql("""
SELECT hotel_id, coalesce(run_id, '') AS run_id, CAST(count(*) AS BIGINT) AS rows FROM priced GROUP BY ALL ORDER BY coalesce(run_id, ''), hotel_id""", SQL_PRICED))
def t4(spark, sf):
    d = observations(spark, sf).groupBy("hotel_id", F.coalesce("run_id", F.lit("")).alias("run_id")).agg(F.count("*").alias("rows"))
    return d.orderBy("run_id", "hotel_id")


@query("U4_hotels_in_both_periods", sql("""
SELECT hotel_id FROM weeks WHERE period = 'current' INTERSECT SELECT hotel_id FROM weeks WHERE period = 'previous'""", SQL_PRICED, SQL_DEDUP, _WEEK))
def u4(spark, sf):
    d = market.weekly_rows(published(spark, sf))
    return d.where("period = 'current'").select("hotel_id").intersect(d.where("period = 'previous'").select("hotel_id"))


@query("U6_distinct_months_and_sources", sql("SELECT DISTINCT strftime(queried_at, '%Y-%m') AS month, source_platform FROM rates"))
def u6(spark, sf):
    return observations(spark, sf).select(F.date_format("queried_at", "yyyy-MM").alias("month"), "source_platform").distinct()


@query("AGG1_all_sources_spread", sql("""
SELECT source_platform, CAST(count(nightly) AS BIGINT) AS n, round(avg(nightly), 4) AS mean, round(median(nightly), 4) AS median, round(min(nightly), 4) AS low, round(max(nightly), 4) AS high
FROM priced GROUP BY 1""", SQL_PRICED))
def spread(spark, sf):
    d = grouped_stats(observations(spark, sf), ["source_platform"], {"p": "nightly_adr_twd"})
    return d.select(
        "source_platform", F.col("p_n").alias("n"), r("p_mean", 4).alias("mean"), r("p_median", 4).alias("median"), r("p_min", 4).alias("low"), r("p_max", 4).alias("high")
    )


