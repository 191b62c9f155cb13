"""N1-N29, P1-P5: scalar rules over whole tables.

Where the view has too little variety, texts are assembled from the columns of the
given tables; the SQL twin then states what each text must yield.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions import cancellation, labels, meals, offers, pricing, tax
from ratelens.operators import catalog, facets
from ratelens.operators.parity import comparison_group_id, with_comparison
from ratelens.sinks.publish import dashboard_rows, heatmap_rows
from ratelens.sources.payloads import size_by_known_name
from registered.book import day, query, r, ts
from registered.view import SQL_PRICED, SQL_TERMS, observations, priced_rates, rates, sql, table

TERMS = SQL_TERMS.replace("{source}", "priced")
KEYED = """
keyed AS (
  SELECT *, CASE WHEN breakfast_included IS NOT NULL AND occupancy <> 'unknown' AND size_band <> 'unknown'
       AND cancellation_class <> 'unknown' AND cancellation_deadline <> 'unknown' AND tax_state <> 'unknown'
    THEN concat_ws('|', hotel_id, CAST(check_in AS VARCHAR), CAST(check_out AS VARCHAR), occupancy, size_band,
         CASE WHEN breakfast_included THEN 'breakfast' ELSE 'room_only' END, cancellation_class,
         cancellation_deadline, tax_state) END AS comparison_key
  FROM terms)
"""


@query("N1_stay_nights", sql("""
SELECT observation_id, CAST(CASE WHEN check_out - check_in > 0 THEN check_out - check_in ELSE 1 END AS INTEGER) AS by_interval,
       CAST(CASE WHEN lead_days = 7 THEN 3 ELSE check_out - check_in END AS INTEGER) AS by_stored
FROM rates"""))
def n1(spark, sf):
    d = rates(spark, sf).withColumn("nights", F.when(F.col("lead_days") == 7, F.lit(3)))
    return d.select(
        "observation_id", pricing.stay_nights().alias("by_interval"), pricing.stay_nights(prefer="stored").alias("by_stored")
    )


@query("N2_total_twd", sql("SELECT observation_id, round(total_twd, 6) AS total_twd FROM priced", SQL_PRICED))
def n2(spark, sf):
    return rates(spark, sf).select("observation_id", r(pricing.total_twd()).alias("total_twd"))


@query("N3_nightly_adr", sql("SELECT observation_id, round(nightly, 6) AS nightly FROM priced", SQL_PRICED))
def n3(spark, sf):
    return rates(spark, sf).select("observation_id", r(pricing.nightly_adr_twd()).alias("nightly"))


@query("N4_price_per_sqm", sql("""
SELECT observation_id, round(CASE WHEN room_size_sqm IS NULL THEN CASE WHEN lead_days = 14 THEN 250.0 / nights END ELSE unit END, 6) AS unit
FROM priced""", SQL_PRICED))
def n4(spark, sf):
    d = rates(spark, sf).withColumn("price_per_sqm", F.when(F.col("lead_days") == 14, F.lit(250.0)))
    return pricing.priced(d).select("observation_id", r("price_per_sqm").alias("unit"))


@query("N5_cpi_adjusted", sql("""
SELECT observation_id, round(CASE WHEN lead_days = 90 THEN 9000.0 / nights ELSE nightly * 100 / (100 + month(check_in)) END, 6) AS adjusted
FROM priced""", SQL_PRICED))
def n5(spark, sf):
    live = F.col("lead_days") != 90
    d = rates(spark, sf).withColumns(
        {
            "cpi_index": F.when(live, 100 + F.month("check_in")),
            "cpi_base_index": F.when(live, F.lit(100)),
            "cpi_adjusted_twd": F.lit(9000.0),
        }
    )
    return pricing.priced(d).select("observation_id", r("cpi_adjusted_nightly_twd").alias("adjusted"))


def _fx_table(spark, sf):
    d = rates(spark, sf)
    return d.groupBy("currency").agg((F.lit(1.0) / F.max(F.col("fx_rate_to_twd").cast("double"))).alias("foreign_per_twd"))


@query("N6_fx_conversion", sql("""
SELECT currency, CAST(count(*) AS BIGINT) AS n, round(sum(total_price * fx_rate_to_twd), 2) AS total_twd,
       round(sum(total_price * 0.25), 2) AS displayed
FROM rates GROUP BY currency"""))
def n6(spark, sf):
    d = catalog.with_fx(rates(spark, sf).withColumn("fx_rate_to_twd", F.lit(None).cast("double")), _fx_table(spark, sf))
    shown = pricing.display_amount("total_price", F.lit(0.25))
    return d.groupBy("currency").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("total_price").cast("double") * F.col("fx_rate_to_twd")), 2).alias("total_twd"),
        F.round(F.sum(shown), 2).alias("displayed"),
    )


@query("J6_fx_cpi_enrichment", sql("""
SELECT observation_id, round(fx_rate_to_twd, 6) AS fx, CAST(100 + month(queried_at) AS DOUBLE) AS cpi_index,
       round(total_price * fx_rate_to_twd, 4) AS twd
FROM rates"""))
def j6(spark, sf):
    d = rates(spark, sf)
    months = d.select(F.date_format("queried_at", "yyyy-MM").alias("month")).distinct().withColumn(
        "cpi_index", F.lit(100.0) + F.substring("month", 6, 2).cast("int")
    )
    out = catalog.with_cpi(catalog.with_fx(d.withColumn("fx_rate_to_twd", F.lit(None).cast("double")), _fx_table(spark, sf)), months, 100.0)
    return out.select(
        "observation_id", r("fx_rate_to_twd").alias("fx"), r("cpi_index", 4).alias("cpi_index"),
        r(F.col("total_price").cast("double") * F.col("fx_rate_to_twd"), 4).alias("twd"),
    )


@query("N7_size_band", sql("""
SELECT CASE WHEN lead_days = 60 THEN 'kept' WHEN room_size_sqm IS NULL THEN 'unknown' WHEN room_size_sqm < 45 THEN '<45㎡'
            WHEN room_size_sqm < 60 THEN '45–59㎡' WHEN room_size_sqm < 80 THEN '60–79㎡' ELSE '80㎡+' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM rates GROUP BY 1"""))
def n7(spark, sf):
    d = rates(spark, sf).withColumn("size_band", F.when(F.col("lead_days") == 60, F.lit("kept")).otherwise(F.lit("unknown")))
    return d.groupBy(pricing.size_band().alias("band")).agg(F.count("*").alias("n"))


@query("N8_occupancy_key", """
SELECT CASE WHEN l_linenumber % 4 = 0 OR l_linenumber = 5 THEN 'unknown'
            ELSE concat(l_linenumber % 4, 'r-', l_linenumber % 5, 'a-', l_linenumber % 3, 'c') END AS occupancy,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1""")
def n8(spark, sf):
    n = F.col("l_linenumber")
    d = table(spark, sf, "lineitem").select((n % 4).alias("rooms"), (n % 5).alias("adults"), (n % 3).alias("children"))
    return d.groupBy(pricing.occupancy_key().alias("occupancy")).agg(F.count("*").alias("n"))


@query("N9_tax_inclusion", sql("SELECT observation_id, tax_state AS tax_inclusion FROM terms", SQL_PRICED, TERMS))
def n9(spark, sf):
    return rates(spark, sf).select("observation_id", tax.tax_inclusion().alias("tax_inclusion"))


@query("N10_mirror_tax_inclusion", sql("""
SELECT observation_id,
       CASE WHEN tax_inclusion <> 'unknown' THEN tax_inclusion
            WHEN hotel_id = 'hotel_3' AND source_platform = 'official' AND lead_days IN (1, 7) THEN 'included'
            WHEN price_before_tax IS NOT NULL AND (service_charge IS NOT NULL OR tax IS NOT NULL)
             AND abs(total_price - (price_before_tax + coalesce(service_charge, 0) + coalesce(tax, 0)))
                 <= greatest(1.0, abs(total_price) * 0.0001) THEN 'included'
            ELSE 'unknown' END AS tax_inclusion
FROM rates"""))
def n10(spark, sf):
    rules = ({"hotel_id": "hotel_3", "source_method": "public_booking_page", "url_like": "%plan=7%"},)
    d = rates(spark, sf).withColumns(
        {
            "source_method": F.when(F.col("lead_days") == 1, F.lit("public_booking_page")),
            "source_url": F.concat(F.lit("https://example.test/?plan="), F.col("lead_days"), F.lit(";")),
        }
    )
    rules = ({**rules[0], "url_like": "%plan=7;%"},)
    return d.select("observation_id", tax.mirror_tax_inclusion(rules).alias("tax_inclusion"))


_POLICY = """
policies AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 24 AS k, 1 + l_linenumber AS n,
         {check_in} AS check_in,
         CASE l_partkey % 24
           WHEN 0 THEN 'Free  cancellation' WHEN 1 THEN 'NON-REFUNDABLE rate'
           WHEN 2 THEN concat(1 + l_linenumber, ' days prior to arrival')
           WHEN 3 THEN 'Free cancellation before 2026-03-05'
           WHEN 4 THEN concat('入住前至少 ', 1 + l_linenumber, ' 天')
           WHEN 5 THEN '免費取消' WHEN 6 THEN '此專案不可退款'
           WHEN 7 THEN '12月25日前可免費取消' WHEN 8 THEN 'three days prior to check-in'
           WHEN 9 THEN 'until the day prior to arrival' WHEN 10 THEN '預定住宿日前第二十日以前'
           WHEN 11 THEN 'cancelled after 18:00 on 5 March 2026' WHEN 12 THEN 'before 2026/2/30'
           WHEN 13 THEN 'Fee � applies'
           WHEN 14 THEN concat('抵達前免費取消最多 15:00 ', 1 + l_linenumber, ' 天')
           WHEN 15 THEN '13~4天前收取訂金30%，3-1日前收取訂金70%，當天收取訂金100%'
           WHEN 16 THEN NULL WHEN 17 THEN '' WHEN 18 THEN '0 days prior to arrival'
           WHEN 19 THEN concat('抵達前 ', 1 + l_linenumber, ' 日')
           WHEN 20 THEN 'fourteen (14) days prior to arrival'
           WHEN 21 THEN '1-3日前訂金的50%，當天訂金10%'
           WHEN 22 THEN 'Cancellation policy is available on the official booking page'
           ELSE '將收取取消費用' END AS cancellation_policy
  FROM lineitem)
"""
_SQL_POLICY = "WITH " + _POLICY.format(check_in="DATE '2026-01-01' + CAST(l_orderkey % 400 AS INTEGER)").strip() + "\n"
_CLASS = """CASE WHEN k IN (0, 5) THEN 'free_cancellation' WHEN k IN (1, 6) THEN 'non_refundable'
     WHEN k IN (13, 16, 17, 22, 23) THEN 'unknown' ELSE 'conditional' END"""


def policies(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(
        "WITH " + _POLICY.format(check_in="date_add(DATE '2026-01-01', CAST(l_orderkey % 400 AS INT))") + " SELECT * FROM policies"
    )


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("N11_cancellation_class", _SQL_POLICY + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CLASS} AS cancellation_class FROM policies")
def n11(spark, sf):
    return cancellation.with_policy_terms(policies(spark, sf)).select(*_LINE, "cancellation_class")


@query("N12_cancellation_deadline", _SQL_POLICY + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN k IN (0, 5) THEN 'unrestricted' WHEN k IN (1, 6) THEN 'non_refundable'
       WHEN k IN (2, 4, 14, 19) THEN strftime(check_in - CAST(n AS INTEGER), '%Y-%m-%d')
       WHEN k IN (3, 11) THEN '2026-03-05'
       WHEN k = 7 THEN CASE WHEN check_in >= make_date(year(check_in), 12, 25) THEN strftime(make_date(year(check_in), 12, 25), '%Y-%m-%d')
                            ELSE strftime(make_date(year(check_in) - 1, 12, 25), '%Y-%m-%d') END
       WHEN k = 8 THEN strftime(check_in - 3, '%Y-%m-%d') WHEN k = 9 THEN strftime(check_in - 1, '%Y-%m-%d')
       WHEN k = 10 THEN strftime(check_in - 20, '%Y-%m-%d') WHEN k = 20 THEN strftime(check_in - 14, '%Y-%m-%d')
       ELSE 'unknown' END AS cancellation_deadline
FROM policies""")
def n12(spark, sf):
    return cancellation.with_policy_terms(policies(spark, sf)).select(*_LINE, "cancellation_deadline")


@query("N13_cancellation_schedule", _SQL_POLICY + """
, tiers AS (SELECT * FROM (VALUES (13, 4, 30), (3, 1, 70), (0, 0, 100)) AS t(days_from, days_to, penalty))
SELECT days_from, days_to, penalty, CAST(count(*) AS BIGINT) AS rows
FROM policies CROSS JOIN tiers WHERE k = 15 GROUP BY ALL""")
def n13(spark, sf):
    d = policies(spark, sf).select(F.explode(cancellation.cancellation_schedule()).alias("t"))
    return d.groupBy(
        F.col("t.days_before_from").alias("days_from"), F.col("t.days_before_to").alias("days_to"), F.col("t.penalty_percent").alias("penalty")
    ).agg(F.count("*").alias("rows"))


@query("N14_cancellation_blocker", _SQL_POLICY + """
SELECT CASE k WHEN 13 THEN 'encoding_corruption' WHEN 22 THEN 'generic_placeholder' WHEN 23 THEN 'generic_fee_notice'
       ELSE 'unparsed_policy' END AS reason, CAST(count(*) AS BIGINT) AS rows
FROM policies GROUP BY 1""")
def n14(spark, sf):
    return policies(spark, sf).groupBy(cancellation.cancellation_blocker().alias("reason")).agg(F.count("*").alias("rows"))


_MEALS = """
plans AS (
  SELECT l_partkey % 12 AS k, CASE WHEN l_linenumber = 7 THEN true END AS breakfast_included,
    CASE l_partkey % 12 WHEN 0 THEN 'BAR  with Breakfast' WHEN 1 THEN 'Room  Only' WHEN 2 THEN '含早餐專案'
      WHEN 3 THEN '不含早餐' WHEN 4 THEN '含2客早餐' WHEN 5 THEN '含 2 早' WHEN 6 THEN '純住宿優惠'
      WHEN 7 THEN '無精緻早餐' WHEN 8 THEN 'Member offer' WHEN 9 THEN '' WHEN 10 THEN 'Breakfast not included' ELSE NULL END AS rate_plan_name
  FROM lineitem)
"""


@query("N15_breakfast_from_label", "WITH " + _MEALS.strip() + """
SELECT rate_plan_name, CASE WHEN breakfast_included OR k IN (0, 2, 4, 5) THEN 'yes' WHEN k IN (1, 3, 6, 7, 10) THEN 'no' ELSE 'unknown' END AS breakfast,
       CAST(count(*) AS BIGINT) AS rows
FROM plans GROUP BY ALL""")
def n15(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    d = meals.with_breakfast(spark.sql("WITH " + _MEALS + " SELECT * FROM plans"))
    flag = F.when(F.col("breakfast_included"), F.lit("yes")).when(~F.col("breakfast_included"), F.lit("no")).otherwise(F.lit("unknown"))
    return d.groupBy("rate_plan_name", flag.alias("breakfast")).agg(F.count("*").alias("rows"))


_LABELS = """
labels_ AS (
  SELECT p_partkey, p_name,
    CASE p_partkey % 5 WHEN 0 THEN concat(upper(p_name), ' (ＫＩＮＧ)') WHEN 1 THEN concat(' ', p_name, '-①')
      WHEN 2 THEN concat('豪華 ', p_name, '｜雙床') WHEN 3 THEN concat('STRASSE ', p_name) ELSE NULL END AS room_type_name
  FROM part)
"""


@query("N16_label_normaliser", "WITH " + _LABELS.strip() + """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(replace(p_name, ' ', ''), 'king') WHEN 1 THEN concat(replace(p_name, ' ', ''), '1')
  WHEN 2 THEN concat('豪華', replace(p_name, ' ', ''), '雙床') WHEN 3 THEN concat('strasse', replace(p_name, ' ', '')) ELSE '' END AS norm_label
FROM labels_""")
def n16(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    d = spark.sql("WITH " + _LABELS + " SELECT * FROM labels_")
    return labels.with_normalized_label(d).select("p_partkey", "norm_label")


_ROOMS = """
rooms_ AS (
  SELECT p_partkey,
    CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' Villa Suite') WHEN 1 THEN concat(p_name, ' Suite King')
      WHEN 2 THEN concat(p_name, ' Residence Twin') WHEN 3 THEN p_name WHEN 4 THEN concat(p_name, ' double queen') ELSE NULL END AS name_en,
    CASE p_partkey % 6 WHEN 3 THEN '豪華套房' WHEN 5 THEN '雙床客房' ELSE NULL END AS name_zh,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE NULL END AS DOUBLE) AS size_sqm,
    CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size + 0.5 ELSE NULL END AS DOUBLE) AS size_sqm_min,
    CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size + 10 ELSE NULL END AS DOUBLE) AS size_sqm_max
  FROM part)
"""


def _rooms(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql("WITH " + _ROOMS + " SELECT *, CAST(NULL AS STRING) AS name_ja, CAST(NULL AS ARRAY<STRING>) AS aliases_zh FROM rooms_")


@query("N17_room_class", "WITH " + _ROOMS.strip() + """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'villa' WHEN 1 THEN 'suite' WHEN 2 THEN 'residence' WHEN 3 THEN 'suite' ELSE 'room' END AS room_class
FROM rooms_""")
def n17(spark, sf):
    return _rooms(spark, sf).select("p_partkey", labels.room_class().alias("room_class"))


@query("N18_bed_type", "WITH " + _ROOMS.strip() + """
SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'king' WHEN 2 THEN 'twin' WHEN 4 THEN 'multiple' WHEN 5 THEN 'twin' ELSE 'unspecified' END AS bed_type
FROM rooms_""")
def n18(spark, sf):
    return _rooms(spark, sf).select("p_partkey", labels.bed_type().alias("bed_type"))


@query("N19_area_spec", """
SELECT p_partkey, CASE WHEN p_size <= 0 AND p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN p_size + 0.5 END AS size_sqm_min,
       CASE WHEN p_size <= 0 AND p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN CAST(p_size + 10 AS DOUBLE) END AS size_sqm_max,
       CASE WHEN p_size <= 0 AND p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN concat(p_size, '.5-', p_size + 10) END AS area_spec_key
FROM part""")
def n19(spark, sf):
    return _rooms(spark, sf).select("p_partkey", labels.area_spec().alias("a")).select("p_partkey", "a.*")


@query("N20_stable_room_id", """
SELECT p_partkey, concat('rt_', substr(sha256(concat('hotel_', p_partkey % 31, '|', lower(p_name), '||', '|', CAST(p_size AS VARCHAR))), 1, 16)) AS stable_id
FROM part""")
def n20(spark, sf):
    d = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("hotel_"), F.col("p_partkey") % 31).alias("hotel_id"),
        F.concat(F.lit(" "), F.upper("p_name")).alias("name_en"), F.lit(None).cast("string").alias("name_zh"),
        F.lit(None).cast("string").alias("name_ja"), F.col("p_size").cast("string").alias("area_spec_key"),
    )
    return d.select("p_partkey", labels.stable_room_id().alias("stable_id"))


@query("N21_comparison_group_id", sql("""
SELECT substr(sha256(comparison_key), 1, 16) AS group_id, CAST(count(*) AS BIGINT) AS rows FROM keyed GROUP BY 1""", SQL_PRICED, TERMS, KEYED))
def n21(spark, sf):
    d = with_comparison(observations(spark, sf))
    return d.groupBy(comparison_group_id().alias("group_id")).agg(F.count("*").alias("rows"))


@query("N22_month_and_day_key", """
SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY ALL""")
def n22(spark, sf):
    d = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("queried_at"))
    return d.groupBy(F.date_format("queried_at", "yyyy-MM").alias("month"), day("queried_at").alias("day")).agg(F.count("*").alias("rows"))


@query("N23_published_columns", sql("""
SELECT hotel_id, room_type_name, CAST(check_in AS VARCHAR) AS check_in, nights, round(nightly, 6) AS nightly_adr_twd, size_band, occupancy,
       cancellation_class, cancellation_deadline, tax_state AS tax_inclusion, comparison_key,
       CASE WHEN comparison_key IS NULL THEN 'insufficient_product_metadata' ELSE 'comparable' END AS comparison_status
FROM keyed""", SQL_PRICED, TERMS, KEYED))
def n23(spark, sf):
    d = dashboard_rows(with_comparison(observations(spark, sf)))
    return d.select(
        "hotel_id", "room_type_name", day("check_in").alias("check_in"), "nights", r("nightly_adr_twd").alias("nightly_adr_twd"),
        "size_band", "occupancy", "cancellation_class", "cancellation_deadline", "tax_inclusion", "comparison_key", "comparison_status",
    )


@query("N23_heatmap_columns", sql("""
SELECT hotel_id, room_type_code, lead_days, strftime(queried_at, '%Y-%m-%d %H:%M:%S') AS queried_at, source_platform,
       substr(sha256(comparison_key), 1, 16) AS comparison_group_id
FROM keyed""", SQL_PRICED, TERMS, KEYED))
def n23b(spark, sf):
    d = heatmap_rows(with_comparison(observations(spark, sf)))
    return d.select("hotel_id", "room_type_code", "lead_days", ts("queried_at").alias("queried_at"), "source_platform", "comparison_group_id")


@query("N24_area_from_offer_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_partkey % 6 WHEN 0 THEN CAST(l_quantity AS DOUBLE) WHEN 1 THEN CAST(round(CAST(l_quantity AS DECIMAL(12,2)) * 3.305785, 2) AS DOUBLE)
    ELSE NULL END AS offer,
  CASE l_partkey % 6 WHEN 1 THEN CAST(round(CAST(l_quantity AS DECIMAL(12,2)) * 3.305785, 1) AS DOUBLE) END AS ping_tenth,
  CASE l_partkey % 6 WHEN 2 THEN l_quantity WHEN 3 THEN l_quantity WHEN 0 THEN l_quantity END AS metric_or_m2,
  CASE WHEN l_partkey % 6 = 3 THEN l_quantity END AS labelled,
  CASE l_partkey % 6 WHEN 4 THEN l_quantity WHEN 5 THEN CAST(round(CAST(l_quantity AS DECIMAL(12,2)) * 0.09290304, 2) AS DOUBLE) END AS by_unit
FROM lineitem""")
def n24(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_partkey") % 6
    text = (
        F.when(k == 0, F.concat(q, F.lit(" 平方公尺 豪華客房")))
        .when(k == 1, F.concat(F.lit("約"), q, F.lit("坪")))
        .when(k == 2, F.concat(F.lit("size "), q, F.lit(" M²")))
        .when(k == 3, F.concat(F.lit("Room size: "), q, F.lit(" m²")))
        .otherwise(F.lit("room"))
    )
    unit = F.when(k == 4, F.lit("Square-Meters")).when(k == 5, F.lit("SQFT")).otherwise(F.lit("tatami"))
    d = table(spark, sf, "lineitem").withColumns({"t": text, "u": unit})
    return d.select(
        *_LINE,
        offers.area_from_offer("t").cast("double").alias("offer"),
        offers.area_from_ping("t", 1).cast("double").alias("ping_tenth"),
        offers.area_from_text("t", "metric_or_m2").cast("double").alias("metric_or_m2"),
        offers.area_from_text("t", "labelled").cast("double").alias("labelled"),
        offers.area_from_unit("l_quantity", "u").cast("double").alias("by_unit"),
    )


@query("N25_money_and_currency", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS amount,
  CASE l_partkey % 5 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'TWD'
    ELSE CASE WHEN l_extendedprice < 3000 THEN 'USD' ELSE 'TWD' END END AS currency
FROM lineitem""")
def n25(spark, sf):
    a = F.format_number("l_extendedprice", 2)
    k = F.col("l_partkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("NT$ "), a)).when(k == 1, F.concat(F.lit("US$"), a)).when(k == 2, F.concat(F.lit("¥"), a))
        .when(k == 3, F.concat(F.lit("NTD "), a)).otherwise(a)
    )
    d = table(spark, sf, "lineitem").withColumn("t", text)
    money = offers.money_from_text("t")
    return d.select(*_LINE, r(money, 2).alias("amount"), offers.resolve_currency(F.col("t"), money).alias("currency"))


@query("N26_tax_split", """
WITH b AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18,4)) AS total FROM lineitem),
s AS (SELECT *, floor(total / 1.155 + 0.5) AS base FROM (SELECT *, total FROM b)),
t AS (SELECT *, floor(CAST(base AS DECIMAL(18,4)) * 0.10 + 0.5) AS service FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(base AS DOUBLE) AS base, CAST(service AS DOUBLE) AS service,
  CAST(floor(total - CAST(base AS DECIMAL(18,4)) - CAST(service AS DECIMAL(18,4)) + 0.5) AS DOUBLE) AS tax,
  CAST(floor(total * 0.10 + 0.5) AS DOUBLE) AS fwd_service,
  CAST(floor((total + CAST(floor(total * 0.10 + 0.5) AS DECIMAL(18,4))) * 0.05 + 0.5) AS DOUBLE) AS fwd_tax
FROM t""")
def n26(spark, sf):
    d = table(spark, sf, "lineitem")
    d = tax.add_tax_components(tax.split_inclusive_total(d, "l_extendedprice"), "l_extendedprice")
    return d.select(
        *_LINE, F.col("split_base").cast("double").alias("base"), F.col("split_service").cast("double").alias("service"),
        F.col("split_tax").cast("double").alias("tax"), F.col("added_service").cast("double").alias("fwd_service"),
        F.col("added_tax").cast("double").alias("fwd_tax"),
    )


@query("N27_plan_filters", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(lower(rate_plan_name) NOT LIKE '%member%') AS BIGINT) AS public_rows
FROM rates WHERE CASE hotel_id WHEN 'hotel_1' THEN starts_with(rate_plan_name, 'BAR') WHEN 'hotel_2' THEN contains(rate_plan_name, 'only')
  WHEN 'hotel_3' THEN starts_with(replace(rate_plan_name, ' ', ''), 'BARwith') ELSE true END
GROUP BY hotel_id"""))
def n27(spark, sf):
    d = rates(spark, sf)
    rules = d.select("hotel_id").distinct().where(F.col("hotel_id").isin("hotel_1", "hotel_2", "hotel_3")).withColumns(
        {
            "how": F.when(F.col("hotel_id") == "hotel_2", F.lit("contains")).otherwise(F.lit("prefix")),
            "text": F.when(F.col("hotel_id") == "hotel_1", F.lit("BAR")).when(F.col("hotel_id") == "hotel_2", F.lit("only")).otherwise(F.lit("BARwith")),
            "squeeze": F.col("hotel_id") == "hotel_3",
        }
    )
    return offers.baseline_plans(d, rules).groupBy("hotel_id").agg(
        F.count("*").alias("rows"), F.count_if(offers.public_plan("rate_plan_name")).alias("public_rows")
    )


@query("N28_redaction", """
SELECT event_id, concat('HTTP ', 400 + event_id % 30, ' for https://x.test/?token=[redacted]&k=', json_extract_string(props, '$.k'), ' [redacted authorization]') AS reason,
  CAST(400 + event_id % 30 AS INTEGER) AS status_code
FROM events""")
def n28(spark, sf):
    d = table(spark, sf, "events").withColumn(
        "t",
        F.concat(
            F.lit("HTTP "), 400 + F.col("event_id") % 30, F.lit("  for\n https://x.test/?token=s"), "event_id", F.lit("&k="),
            F.get_json_object("props", "$.k"), F.lit("  Bearer abc.DEF"), "event_id",
        ),
    )
    return d.select("event_id", offers.safe_reason("t").alias("reason"), offers.status_from_text("t").alias("status_code"))


@query("N29_size_by_known_name", sql("""
SELECT observation_id, CAST(CASE
    WHEN room_type_name LIKE '%red widget%' THEN 33.0 WHEN room_type_name LIKE '%widget%' THEN 30.0
    WHEN room_type_name LIKE '%bolt%' THEN 20.0 END AS DOUBLE) AS known_size_sqm
FROM rates"""))
def n29(spark, sf):
    d = rates(spark, sf)
    hotels = d.select("hotel_id").distinct()
    known = hotels.select(
        "hotel_id",
        F.explode(
            F.array(
                F.struct(F.lit("widget").alias("known_name"), F.lit(30.0).alias("size_sqm")),
                F.struct(F.lit("red widget").alias("known_name"), F.lit(33.0).alias("size_sqm")),
                F.struct(F.lit("bolt").alias("known_name"), F.lit(20.0).alias("size_sqm")),
            )
        ).alias("x"),
    ).select("hotel_id", "x.*")
    return size_by_known_name(d, known).select("observation_id", "known_size_sqm")


@query("P1_publishable", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows FROM priced WHERE status = 'live' AND nightly BETWEEN 3000 AND 2000000 GROUP BY 1""", SQL_PRICED))
def p1(spark, sf):
    return priced_rates(spark, sf).where(pricing.publishable()).groupBy("hotel_id").agg(F.count("*").alias("rows"))


@query("P2_verified_market", sql("SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows FROM official GROUP BY 1", SQL_PRICED))
def p2(spark, sf):
    return observations(spark, sf).where(pricing.verified_market()).groupBy("hotel_id").agg(F.count("*").alias("rows"))


@query("P3_api_filter", sql("""
SELECT observation_id, round(nightly, 6) AS nightly FROM terms WHERE hotel_id = 'hotel_7' AND size_band = '45–59㎡' AND lead_days = 30""", SQL_PRICED, TERMS))
def p3(spark, sf):
    d = facets.select_rates(observations(spark, sf), hotels="hotel_7", band="45–59㎡", leads=30)
    return d.select("observation_id", r("nightly_adr_twd").alias("nightly"))


@query("P4_dashboard_filter", sql("""
SELECT hotel_id, lead_days, CAST(count(*) AS BIGINT) AS rows FROM priced
WHERE city = 'Taipei' AND hotel_id IN ('hotel_1', 'hotel_2', 'hotel_3', 'hotel_25') AND lead_days IN (7, 14) AND source_platform = 'booking_com'
GROUP BY ALL""", SQL_PRICED))
def p4(spark, sf):
    d = facets.select_rates(
        observations(spark, sf), city="Taipei", hotels=["hotel_1", "hotel_2", "hotel_3", "hotel_25"], leads=[7, 14],
        source="booking_com", band="45–59㎡", ignore_band=True,
    )
    return d.groupBy("hotel_id", "lead_days").agg(F.count("*").alias("rows"))


@query("P5_core_rooms", sql("""
SELECT hotel_id, CAST(count_if(is_core) AS BIGINT) AS core_rows, CAST(count(*) AS BIGINT) AS rows FROM priced GROUP BY 1""", SQL_PRICED))
def p5(spark, sf):
    return facets.core_share(observations(spark, sf)).select("hotel_id", "core_rows", "rows")
