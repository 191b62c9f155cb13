"""J7-J9, J14-J15, J17, U5, DQ16-DQ18, PLAN1-PLAN3: catalog, profiles, registries,
planning. Hotels, profiles and registries are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import catalog, planning, profiles, registry
from ratelens.operators.rooms import ROOM
from registered.book import day, query
from registered.view import observations, rates, sql, table


def _suppliers(spark, sf):
    """One hotel per supplier: id, name, city by nation, enabled by balance."""
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("hotel_"), "s_suppkey").alias("hotel_id"), "s_suppkey", F.col("s_name").alias("name"),
        F.concat(F.lit("city_"), "s_nationkey").alias("city"), (F.col("s_acctbal") > 0).alias("enabled"),
    )


_H = """
WITH s AS (SELECT concat('hotel_', s_suppkey) AS hotel_id, s_suppkey AS k, s_name AS name, concat('city_', s_nationkey) AS city, s_acctbal > 0 AS enabled FROM supplier)
"""


@query("J7_catalog_merge", _H + """
SELECT hotel_id, CASE WHEN k % 3 = 0 THEN concat(name, ' new') WHEN k % 3 = 1 AND k % 2 = 0 THEN NULL ELSE name END AS name, city,
  enabled OR k % 3 < 2 AS enabled, CASE WHEN k % 3 < 2 THEN CAST(k AS INTEGER) END AS rooms, CASE WHEN k % 5 = 0 THEN 2000 + CAST(k AS INTEGER) END AS opening_year
FROM s""")
def j7(spark, sf):
    s = _suppliers(spark, sf)
    k = F.col("s_suppkey")
    earlier = s.drop("s_suppkey")
    later = s.where(k % 3 < 2).select(
        "hotel_id",
        F.when(k % 3 == 0, F.concat("name", F.lit(" new"))).otherwise(F.when(k % 2 != 0, F.col("name"))).alias("name"),
        k.cast("int").alias("rooms"),
    )
    opening = s.where(k % 5 == 0).select("hotel_id", (2000 + k.cast("int")).alias("opening_year"))
    return catalog.overlay(catalog.merge_catalog(earlier, later, daily=True), opening)


@query("J8_orphan_overlays", "SELECT concat('hotel_', c_custkey) AS hotel_id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j8(spark, sf):
    facts = table(spark, sf, "customer").select(F.concat(F.lit("hotel_"), "c_custkey").alias("hotel_id"))
    return catalog.orphans(facts, _suppliers(spark, sf))


@query("U5_key_set_difference", """
SELECT concat('hotel_', s_suppkey) AS hotel_id, 'missing' AS side FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 2 FROM customer)
UNION ALL SELECT concat('hotel_', c_custkey * 2), 'extra' FROM customer WHERE c_custkey * 2 NOT IN (SELECT s_suppkey FROM supplier)""")
def u5(spark, sf):
    other = table(spark, sf, "customer").select(F.concat(F.lit("hotel_"), F.col("c_custkey") * 2).alias("hotel_id"))
    return catalog.key_set_difference(_suppliers(spark, sf), other)


@query("J9_location_sync", _H + "SELECT hotel_id, enabled AS daily_tracked, enabled <> (k % 2 = 0) AS changed FROM s")
def j9(spark, sf):
    s = _suppliers(spark, sf)
    loc = s.select("hotel_id", (F.col("s_suppkey") % 2 == 0).alias("daily_tracked"))
    return catalog.sync_tracking(loc, s).select("hotel_id", "daily_tracked", "changed")


def _mapping(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("hotel_"), k).alias("hotel_id"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" p"), k)).alias("property_id")
    )


@query("J15_property_mapping", """
SELECT concat('hotel_', c_custkey) AS hotel_id, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN concat('p', c_custkey) ELSE '' END AS property_id,
  CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN '' ELSE 'Unknown hotel mapping' END AS error
FROM customer WHERE c_custkey % 4 <> 0""")
def j15(spark, sf):
    good, bad = catalog.property_mapping(_mapping(spark, sf), _suppliers(spark, sf))
    return good.select("hotel_id", "property_id", F.lit("").alias("error")).unionByName(bad.select("hotel_id", F.lit("").alias("property_id"), "error"))


@query("J17_localised_names", sql("""
SELECT CASE hotel_id WHEN 'hotel_1' THEN '飯店一' WHEN 'hotel_3' THEN '飯店三' ELSE hotel_name END AS display_name, CAST(count(*) AS BIGINT) AS rows FROM rates GROUP BY 1"""))
def j17(spark, sf):
    d = observations(spark, sf)
    n = d.select("hotel_id").distinct().where(F.col("hotel_id").isin("hotel_1", "hotel_2", "hotel_3")).withColumn(
        "localized_name", F.when(F.col("hotel_id") == "hotel_1", F.lit("飯店一")).when(F.col("hotel_id") == "hotel_3", F.lit("飯店三")).otherwise(F.lit(""))
    )
    return catalog.localized_names(d, n).groupBy("display_name").agg(F.count("*").alias("rows"))


def _hotel_profiles(spark, sf):
    """A profile per supplier whose rooms are the parts that share its remainder."""
    s = table(spark, sf, "supplier")
    n = s.agg(F.count("*")).scalar()
    k = F.col("s_suppkey")
    no = F.lit(None).cast("string")
    p = F.col("p_partkey")
    room = F.struct(
        F.when(p % 2 == 0, F.concat(F.lit("房"), p)).alias("name_zh"), F.col("p_name").alias("name_en"), F.when(p % 3 != 0, F.lit("部屋")).alias("name_ja"),
        F.when(p % 5 != 0, F.col("p_size").cast("double")).alias("size_sqm"), F.lit(None).cast("double").alias("size_sqm_min"), F.lit(None).cast("double").alias("size_sqm_max"),
        F.lit(None).cast("int").alias("room_count"), F.lit(None).cast("array<string>").alias("aliases_zh"),
        F.array().cast("array<struct<label:string,language:string,source_type:string,source_platform:string,room_type_code:string,source_url:string,observed_at:string,label_match:boolean>>").alias("aliases"),
    )
    rooms = table(spark, sf, "part").withColumn("s_suppkey", F.col("p_partkey") % (n * 2)).groupBy("s_suppkey").agg(F.collect_list(room).alias("rooms"))
    flag = lambda i: F.when(k % (i + 2) != 0, k % 2 == 0)
    d = s.join(rooms, "s_suppkey", "left")
    return d.select(
        F.concat(F.lit("hotel_"), k).alias("hotel_id"),
        F.when(k % 11 != 0, F.date_format(F.date_sub(F.lit("2026-09-30").cast("date"), (k % 45).cast("int")), "yyyy-MM-dd")).alias("verified_at"),
        F.struct(F.lit("15:00").alias("check_in"), F.when(k % 4 != 0, F.lit("11:00")).alias("check_out"), F.lit("official").alias("source_type"), F.lit("https://e.test").alias("source_url")).alias("stay_times"),
        F.when(k % 3 != 0, (k % 7).cast("int")).alias("room_inventory"),
        F.when(k % 2 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("restaurants"),
        F.struct(*[flag(i).alias(f) for i, f in enumerate(profiles.FACILITIES)]).alias("facilities"),
        F.struct(F.when(k % 5 != 0, F.lit(True)).alias("available")).alias("lounge"),
        F.struct(
            F.lit("2026-09-01").alias("observed_at"), F.when(k % 6 != 0, F.lit("official")).alias("source_type"), F.lit("https://e.test").alias("source_url"),
            F.coalesce("rooms", F.array().cast(f"array<{ROOM}>")).alias("rooms"),
        ).alias("room_snapshot"),
        F.when(k % 8 != 0, F.array(F.lit("https://e.test"))).alias("source_urls"),
        F.when(
            k % 3 == 0,
            F.array(
                F.struct(
                    F.concat(F.lit("R"), k).alias("name"), (2020 + k % 5).cast("int").alias("guide_year"), F.when(k % 2 == 0, F.lit("one_star")).alias("distinction"),
                    F.lit("2026-09-01").alias("verified_at"), F.lit("https://e.test").alias("source_url"), no.alias("restaurant_url"), no.alias("relationship"),
                )
            ),
        ).alias("michelin_restaurants"),
    )


_PROFILES = """
WITH n AS (SELECT count(*) AS n FROM supplier),
rm AS (SELECT p_partkey % (n * 2) AS k, count(*) AS rooms, count_if(p_partkey % 2 = 0 AND p_partkey % 3 <> 0) AS tri, count_if(p_partkey % 5 <> 0) AS area FROM part, n GROUP BY 1),
s AS (SELECT s_suppkey AS k, coalesce(rooms, 0) AS rooms, coalesce(tri, 0) AS tri, coalesce(area, 0) AS area, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 45 END AS back
      FROM supplier LEFT JOIN rm ON s_suppkey = k),
t AS (SELECT *, back - min(back) OVER () AS age FROM s),
c AS (SELECT *, coalesce(age <= 31, false) AS c1, k % 4 <> 0 AS c2, coalesce(k % 3 <> 0 AND k % 7 > 0, false) AS c3, k % 2 = 0 AS c4, k % 5 <> 0 AS c5, rooms > 0 AND k % 6 <> 0 AS c6,
       k % 8 <> 0 AS c7, rooms > 0 AND tri = rooms AS c8, rooms > 0 AND area = rooms AS c9 FROM t)
"""


@query("DQ16_profile_rows", _PROFILES + """
SELECT concat('hotel_', k) AS hotel_id, CAST(age AS INTEGER) AS review_age_days, CAST(rooms AS INTEGER) AS room_count, CAST(tri AS INTEGER) AS trilingual_room_count, CAST(area AS INTEGER) AS area_documented_room_count,
  CAST((NOT c1)::INT + (NOT c2)::INT + (NOT c3)::INT + (NOT c4)::INT + (NOT c5)::INT + (NOT c6)::INT + (NOT c7)::INT + (NOT c8)::INT + (NOT c9)::INT AS INTEGER) AS missing,
  CAST((k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 4 = 0)::INT + (k % 5 = 0)::INT + (k % 6 = 0)::INT AS INTEGER) AS unknown_facilities
FROM c""")
def dq16(spark, sf):
    d = profiles.profile_rows(_hotel_profiles(spark, sf))
    return d.select(
        "hotel_id", "review_age_days", "room_count", "trilingual_room_count", "area_documented_room_count",
        F.size("missing_evidence").alias("missing"), F.size("unknown_facilities").alias("unknown_facilities"),
    )


@query("DQ16_profile_coverage", _PROFILES + """
SELECT field, count, total, CASE WHEN total > 0 THEN round_even(count * 1.0 / total * 100, 2) ELSE 0 END AS percent FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count_if({c}) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS total FROM c"
    for f, c in [*zip(profiles.CHECKS, [f"c{i}" for i in range(1, 10)]), *[(f, f"k % {i + 2} <> 0") for i, f in enumerate(profiles.FACILITIES)]]
) + """
UNION ALL SELECT 'trilingual_names', CAST(sum(tri) AS BIGINT), CAST(sum(rooms) AS BIGINT) FROM c UNION ALL SELECT 'area_documented', CAST(sum(area) AS BIGINT), CAST(sum(rooms) AS BIGINT) FROM c)""")
def dq16b(spark, sf):
    return profiles.coverage(profiles.profile_rows(_hotel_profiles(spark, sf))).select("field", "count", "total", "percent")


@query("DQ16_awards", """
SELECT CAST(count(*) AS BIGINT) AS restaurant_count, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS hotel_count, CAST(max(2020 + s_suppkey % 5) AS INTEGER) AS latest_guide_year
FROM supplier WHERE s_suppkey % 6 = 0""")
def dq16c(spark, sf):
    return profiles.award_summary(_hotel_profiles(spark, sf))


@query("DQ16_snapshot_sources", "SELECT CASE WHEN s_suppkey % 6 <> 0 THEN 'official' ELSE 'unknown' END AS snapshot_source_type, CAST(count(*) AS BIGINT) AS profiles FROM supplier GROUP BY 1")
def dq16d(spark, sf):
    return profiles.snapshot_source_types(profiles.profile_rows(_hotel_profiles(spark, sf)))


def _registry(spark, sf):
    """One review per customer, wrong in a known way by its key."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(k % 10 != 0, F.concat(F.lit("hotel_"), F.floor(k / 2))).otherwise(F.lit("")).alias("hotel_id"),
        F.lit("official").alias("source_platform"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 9 == 1, F.array(F.lit("tax"), F.lit("tax"))).otherwise(F.array(F.concat(F.lit("f"), k % 4))).alias("missing_fields"),
        F.when(k % 6 == 0, F.lit("open")).otherwise(F.lit("blocked_source_shell")).alias("status"),
        F.when(k % 8 == 0, F.lit("2026-9-1")).otherwise(F.lit("2026-09-01")).alias("reviewed_at"),
        F.array(F.when(k % 11 == 0, F.lit("http://e.test")).otherwise(F.lit("https://e.test"))).alias("evidence_urls"),
        F.when(k % 12 == 0, F.lit("  ")).otherwise(F.lit("n")).alias("note"), k.alias("k"),
    )


@query("DQ17_registry_rejects", """
SELECT c_custkey AS k, concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'hotel_id' END, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 9 = 1 THEN 'missing_fields' END, CASE WHEN c_custkey % 6 = 0 THEN 'status' END,
   CASE WHEN c_custkey % 8 = 0 THEN 'reviewed_at' END, CASE WHEN c_custkey % 11 = 0 THEN 'evidence_urls' END, CASE WHEN c_custkey % 12 = 0 THEN 'note' END,
   CASE WHEN count(*) OVER (PARTITION BY CASE WHEN c_custkey % 10 <> 0 THEN c_custkey // 2 ELSE -1 END, CASE WHEN c_custkey % 7 = 0 THEN 'none' WHEN c_custkey % 9 = 1 THEN 'tax' ELSE concat('f', c_custkey % 4) END) > 1 THEN 'duplicate_key' END) AS reasons
FROM customer QUALIFY reasons <> ''""")
def dq17(spark, sf):
    return registry.metadata_review_rejects(_registry(spark, sf)).select("k", F.array_join("reasons", ",").alias("reasons"))


@query("DQ17_room_registry_rejects", """
SELECT c_custkey AS k, concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'status' END, CASE WHEN c_custkey % 8 = 0 THEN 'reviewed_at' END, CASE WHEN c_custkey % 11 = 0 THEN 'evidence_urls' END) AS reasons
FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 8 = 0 OR c_custkey % 11 = 0""")
def dq17b(spark, sf):
    d = _registry(spark, sf).withColumns(
        {
            "room_type_code": F.concat(F.lit("R"), "k"), "room_type_name": F.lit("room"), "room_size_sqm": F.lit(40.0),
            "status": F.when(F.col("status") == "open", F.col("status")).otherwise(F.lit("blocked_area_mismatch")),
        }
    )
    return registry.room_review_rejects(d).select("k", F.array_join("reasons", ",").alias("reasons"))


@query("DQ18_check_log_rejects", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_linenumber = 7 THEN 'status' END, CASE WHEN l_linenumber = 6 THEN 'reason' END,
  CASE WHEN count(*) OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber) > 1 THEN 'duplicate_key' END) AS reasons
FROM lineitem QUALIFY reasons <> ''""")
def dq18(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.concat(F.lit("hotel_"), "l_suppkey").alias("hotel_id"), F.lit("booking_com").alias("source_platform"),
        F.col("l_orderkey").cast("string").alias("check_in"), F.col("l_linenumber").cast("string").alias("check_out"),
        F.when(F.col("l_linenumber") == 7, F.lit("odd")).otherwise(F.lit("blocked")).alias("status"),
        F.when(F.col("l_linenumber") == 6, F.lit(" ")).otherwise(F.lit("why")).alias("reason"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    return registry.check_log_rejects(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", ",").alias("reasons"))


def _plan_hotels(spark, sf):
    k = F.col("c_custkey")
    zone = F.when(k % 4 == 0, F.lit("Asia/Taipei")).when(k % 4 == 1, F.lit("America/New_York")).when(k % 4 == 2, F.lit("Mars/Base")).otherwise(F.lit("UTC"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("hotel_"), k).alias("hotel_id"), F.lit("web").alias("adapter"), (k % 5 != 0).alias("enabled"), zone.alias("timezone"),
        F.when(k % 3 == 0, F.lit("weekly")).otherwise(F.lit("daily")).alias("collection_frequency"),
        F.when(k % 7 == 0, F.lit("supplemental")).otherwise(F.lit("core")).alias("market_scope"), F.concat(F.lit("d"), k % 6).alias("district"), k.alias("k"),
    )


_AT = "2026-09-06 20:00:00"
_PLAN = """
WITH h AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN DATE '2026-09-07' ELSE DATE '2026-09-06' END AS d FROM customer WHERE c_custkey % 5 <> 0),
due AS (SELECT * FROM h WHERE k % 4 <> 2 AND (k % 3 <> 0 OR d = DATE '2026-09-06')),
cool AS (SELECT k FROM due WHERE k % 13 = 0)
"""


def _plan(spark, sf):
    h = _plan_hotels(spark, sf)
    cool = h.where(F.col("k") % 13 < 2).select(
        "adapter", "hotel_id", F.when(F.col("k") % 13 == 0, F.lit("2026-09-08 00:00:00")).otherwise(F.lit("2026-09-01 00:00:00")).cast("timestamp").alias("cooldown_until")
    )
    return planning.collection_plan(h, planning.parse_lead_days("1,7,14,30,60,90"), F.lit(_AT).cast("timestamp"), F.lit("run-1"), cool)


@query("PLAN1_collection_plan", _PLAN + """
SELECT concat('hotel_', k) AS hotel_id, lead_days, strftime(d + lead_days, '%Y-%m-%d') AS check_in, strftime(d + lead_days + 1, '%Y-%m-%d') AS check_out, 'run-1' AS run_id
FROM due CROSS JOIN (SELECT CAST(unnest([1, 7, 14, 30, 60, 90]) AS INTEGER) AS lead_days) WHERE k NOT IN (SELECT k FROM cool) AND (k % 7 <> 0 OR lead_days IN (14, 60))""")
def plan1(spark, sf):
    req, _ = _plan(spark, sf)
    return req.select("hotel_id", "lead_days", day("check_in").alias("check_in"), day("check_out").alias("check_out"), "run_id")


@query("PLAN3_failure_rows", _PLAN + """
SELECT concat('hotel_', k) AS hotel_id, '' AS lead_days, 'Unknown IANA timezone: Mars/Base' AS error FROM h WHERE k % 4 = 2
UNION ALL SELECT concat('hotel_', k), '', 'Cooldown active until 2026-09-08T00:00:00' FROM cool""")
def plan3(spark, sf):
    return _plan(spark, sf)[1]


@query("J14_plan_size_per_scope", _PLAN + """
SELECT CASE WHEN k % 7 = 0 THEN 'supplemental' ELSE 'core' END AS market_scope, CAST(sum(CASE WHEN k % 7 = 0 THEN 2 ELSE 6 END) AS BIGINT) AS requests FROM due WHERE k NOT IN (SELECT k FROM cool) GROUP BY 1""")
def j14(spark, sf):
    req, _ = _plan(spark, sf)
    return req.join(_plan_hotels(spark, sf).select("hotel_id", "market_scope"), "hotel_id").groupBy("market_scope").agg(F.count("*").alias("requests"))


@query("PLAN2_restamp", sql("""
SELECT observation_id, CAST(check_in - CASE WHEN CAST(substr(hotel_id, 7) AS INTEGER) % 2 = 0 THEN DATE '2026-09-07' ELSE DATE '2026-09-06' END AS INTEGER) AS lead_days, concat('d', CAST(substr(hotel_id, 7) AS INTEGER) % 3) AS district
FROM rates"""))
def plan2(spark, sf):
    d = rates(spark, sf)
    n = F.substring("hotel_id", 7, 9).cast("int")
    h = d.select("hotel_id").distinct().select(
        "hotel_id", F.when(n % 2 == 0, F.lit("Asia/Taipei")).otherwise(F.lit("UTC")).alias("timezone"), F.concat(F.lit("d"), n % 3).alias("district")
    )
    return planning.restamp(d, h, F.lit("run-1"), F.lit(_AT).cast("timestamp")).select("observation_id", "lead_days", "district")


@query("PLAN3_job_summary", sql("""
, e AS (SELECT concat('hotel_', user_id) AS hotel_id, count(*) AS failures FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1),
o AS (SELECT hotel_id, count(*) AS observations FROM rates GROUP BY 1)
SELECT hotel_id, CAST(coalesce(observations, 0) AS BIGINT) AS observations, CAST(coalesce(failures, 0) AS BIGINT) AS failures FROM o FULL JOIN e USING (hotel_id)"""))
def plan3b(spark, sf):
    a = table(spark, sf, "events").select(
        F.concat(F.lit("hotel_"), "user_id").alias("hotel_id"), F.lit(1).alias("lead_days"), F.col("event_type").alias("reason"),
        F.when(F.col("event_type") == "error", F.lit("failure")).when(F.col("event_type") == "signup", F.lit("empty")).otherwise(F.lit("success")).alias("outcome"),
    )
    return planning.job_summary(observations(spark, sf), planning.failure_rows(a))


