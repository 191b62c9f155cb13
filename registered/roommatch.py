"""J1-J4, W6-W7, AGG16, DQ10-DQ15, T5: the room dimension and matching.

Profiles are derived from the given tables: what a hotel evidences is a subset of the
room names and areas that its line items show, with some coded and noun-only aliases.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ratelens.operators import matchquality, rooms
from ratelens.operators.parity import with_comparison
from ratelens.session import cut_lineage
from registered.book import query, r, ts
from registered.view import SQL_PRICED, SQL_TERMS, _written, observations, sql

# One evidenced room per (hotel, name): every name but those of an odd tail, and with
# an area that disagrees now and then.
_PICK = """
seen AS (SELECT hotel_id, room_type_name AS name, min(room_size_sqm) AS lo, max(room_size_sqm) AS hi, count(*) AS n FROM {src} GROUP BY ALL),
evidenced AS (
  SELECT hotel_id, name, CASE WHEN length(name) % 4 = 1 THEN 200.0 WHEN length(name) % 4 = 2 THEN NULL ELSE lo END AS lo,
         CASE WHEN length(name) % 4 = 1 THEN 210.0 WHEN length(name) % 4 = 2 THEN NULL ELSE hi END AS hi,
         CASE WHEN name LIKE 'red %' THEN true ELSE false END AS coded
  FROM seen WHERE name NOT LIKE '%gizmo' AND name NOT LIKE 'blue %'
  UNION ALL
  SELECT DISTINCT hotel_id, 'gizmo', 35.0, 65.0, false FROM seen
  UNION ALL
  SELECT DISTINCT hotel_id, 'blue bolt suite', 50.0, 50.0, false FROM seen)
"""


def profiles(spark, sf):
    """Nested profiles, one per hotel, with rooms as an array of structs."""
    observations(spark, sf).createOrReplaceTempView("mirror")
    e = spark.sql("WITH " + _PICK.format(src="mirror") + " SELECT * FROM evidenced")
    no = F.lit(None).cast("string")
    alias = F.array(
        F.struct(
            F.lit("Special offer").alias("label"), no.alias("language"), no.alias("source_type"),
            F.lit("booking_com").alias("source_platform"), F.concat(F.lit("R"), F.length("name") % 4).alias("room_type_code"),
            F.lit("https://example.test/rooms").alias("source_url"), F.lit("2026-09-01").alias("observed_at"), F.lit(False).alias("label_match"),
        )
    )
    room = F.struct(
        no.alias("name_zh"), F.initcap("name").alias("name_en"), no.alias("name_ja"), F.lit(None).cast("double").alias("size_sqm"),
        F.col("lo").cast("double").alias("size_sqm_min"), F.col("hi").cast("double").alias("size_sqm_max"), F.lit(None).cast("int").alias("room_count"),
        F.lit(None).cast("array<string>").alias("aliases_zh"),
        F.when(F.col("coded"), alias).otherwise(F.array().cast(f"array<{rooms.ALIAS}>")).alias("aliases"),
    )
    return e.groupBy("hotel_id").agg(F.collect_list(room).alias("rooms")).select(
        "hotel_id",
        F.struct(
            F.lit("2026-09-01").alias("observed_at"), F.lit("official").alias("source_type"), F.lit("https://example.test").alias("source_url"), F.col("rooms")
        ).alias("room_snapshot"),
    )


# The same resolution written as plain joins. Coded aliases apply to booking_com.
_MATCH = """
dims AS (
  SELECT hotel_id, name, replace(name, ' ', '') AS norm, lo, hi, coded, concat('R', length(name) % 4) AS code,
         CASE WHEN name LIKE '%suite%' THEN 'suite' ELSE 'room' END AS room_class,
         concat(CASE WHEN name LIKE '%suite%' THEN 'suite' ELSE 'room' END, ':', CASE WHEN lo IS NULL THEN 'unknown' WHEN lo = hi THEN CAST(CAST(lo AS INTEGER) AS VARCHAR)
           ELSE concat(CAST(lo AS INTEGER), '-', CAST(hi AS INTEGER)) END) AS family,
         concat('rt_', substr(sha256(concat_ws('|', hotel_id, name, '', '', CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN CAST(CAST(lo AS INTEGER) AS VARCHAR)
           ELSE concat(CAST(lo AS INTEGER), '-', CAST(hi AS INTEGER)) END)), 1, 16)) AS stable_id
  FROM evidenced),
subj AS (SELECT DISTINCT hotel_id, source_platform, room_type_code, room_type_name, room_size_sqm, replace(room_type_name, ' ', '') AS norm FROM priced),
t1 AS (SELECT s.*, d.stable_id, d.lo, d.hi, d.family, d.room_class, 1 AS tier FROM subj s JOIN dims d ON s.hotel_id = d.hotel_id AND d.coded
       AND s.source_platform = 'booking_com' AND s.room_type_code = d.code),
t2 AS (SELECT s.*, d.stable_id, d.lo, d.hi, d.family, d.room_class, 2 AS tier FROM subj s JOIN dims d ON s.hotel_id = d.hotel_id AND s.norm = d.norm),
t3a AS (SELECT s.*, d.stable_id, d.lo, d.hi, d.family, d.room_class, 3 AS tier, length(d.norm) AS len FROM subj s JOIN dims d ON s.hotel_id = d.hotel_id
        AND contains(s.norm, d.norm) AND length(d.norm) >= 5),
t3 AS (SELECT * EXCLUDE (len, rk) FROM (SELECT *, rank() OVER (PARTITION BY hotel_id, source_platform, room_type_code, room_type_name, room_size_sqm ORDER BY len DESC) AS rk FROM t3a) WHERE rk = 1),
al AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
used AS (SELECT * FROM (SELECT DISTINCT *, rank() OVER (PARTITION BY hotel_id, source_platform, room_type_code, room_type_name, room_size_sqm ORDER BY tier) AS tr FROM al) WHERE tr = 1),
verdict AS (SELECT hotel_id, source_platform, room_type_code, room_type_name, room_size_sqm, min(tier) AS tier,
      count(DISTINCT CASE WHEN room_size_sqm IS NULL OR room_size_sqm BETWEEN lo - 1 AND hi + 1 THEN stable_id END) AS n_fit,
      max(CASE WHEN room_size_sqm IS NULL OR room_size_sqm BETWEEN lo - 1 AND hi + 1 THEN stable_id END) AS sid,
      max(CASE WHEN room_size_sqm IS NULL OR room_size_sqm BETWEEN lo - 1 AND hi + 1 THEN family END) AS fam
    FROM used GROUP BY ALL),
matched AS (
  SELECT p.*, CASE WHEN v.n_fit IS NULL THEN 'unmatched_label' WHEN v.n_fit = 0 THEN 'area_mismatch' WHEN v.n_fit > 1 THEN 'ambiguous_label'
      WHEN v.tier = 1 THEN 'matched_evidenced_source_code' WHEN v.tier = 2 THEN 'matched_exact_evidenced_label'
      ELSE 'matched_evidenced_label_with_descriptors' END AS room_match_status,
    CASE WHEN v.n_fit = 1 THEN v.sid END AS stable_room_type_id, CASE WHEN v.n_fit = 1 THEN v.fam END AS normalized_room_family
  FROM priced p LEFT JOIN verdict v ON p.hotel_id = v.hotel_id AND p.source_platform = v.source_platform AND p.room_type_code = v.room_type_code
    AND p.room_type_name = v.room_type_name AND p.room_size_sqm IS NOT DISTINCT FROM v.room_size_sqm)
"""
_BASE = (SQL_PRICED, _PICK.format(src="priced"), _MATCH)


def matched(spark, sf):
    """Observations with their room, written once like the mirror."""
    key = (spark.sparkContext.applicationId, sf + "#matched")
    if key not in _written:
        d = rooms.match_rooms(observations(spark, sf), rooms.room_dimension(profiles(spark, sf)))
        _written[key] = cut_lineage(d, "matched-" + sf.strip("/").replace("/", "_"))
    return _written[key]


@query("J1_J4_room_match", sql("""
SELECT observation_id, room_match_status, stable_room_type_id, normalized_room_family FROM matched""", *_BASE))
def j1(spark, sf):
    return matched(spark, sf).select("observation_id", "room_match_status", "stable_room_type_id", "normalized_room_family")


@query("J4_match_status_counts", sql("SELECT room_match_status, source_platform, CAST(count(*) AS BIGINT) AS rows FROM matched GROUP BY ALL", *_BASE))
def j4(spark, sf):
    return matched(spark, sf).groupBy("room_match_status", "source_platform").agg(F.count("*").alias("rows"))


@query("DQ15_room_dimension", sql("""
SELECT hotel_id, stable_id AS stable_room_type_id, room_class, family AS normalized_room_family, CAST(lo AS DOUBLE) AS size_sqm_min, CAST(hi AS DOUBLE) AS size_sqm_max,
       'unspecified' AS bed_type, CAST(CASE WHEN coded THEN 1 ELSE 0 END AS INTEGER) AS aliases FROM dims""", *_BASE))
def dq15(spark, sf):
    d = rooms.room_dimension(profiles(spark, sf))
    return d.select(
        "hotel_id", "stable_room_type_id", "room_class", "normalized_room_family", "size_sqm_min", "size_sqm_max", "bed_type", F.size("aliases").alias("aliases")
    )


@query("T5_rooms_by_area", sql("""
SELECT hotel_id, stable_id AS stable_room_type_id, CAST(row_number() OVER (PARTITION BY hotel_id ORDER BY lo NULLS LAST, stable_id) AS INTEGER) AS position
FROM dims""", *_BASE))
def t5(spark, sf):
    w = Window.partitionBy("hotel_id").orderBy(F.col("size_sqm_min").asc_nulls_last(), "stable_room_type_id")
    d = rooms.room_dimension(profiles(spark, sf)).withColumn("position", F.row_number().over(w))
    return d.select("hotel_id", "stable_room_type_id", "position")


@query("AGG16_hotel_room_summaries", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS room_name_count, CAST(count(DISTINCT split_part(family, ':', 2)) FILTER (lo IS NOT NULL) AS BIGINT) AS area_spec_count,
       CAST(count(DISTINCT family) AS BIGINT) AS normalized_family_count FROM dims GROUP BY 1""", *_BASE))
def agg16(spark, sf):
    return rooms.hotel_room_summaries(rooms.room_dimension(profiles(spark, sf)))


@query("DQ13_source_code_conflicts", sql("""
SELECT hotel_id, 'booking_com' AS source_platform, code AS room_type_code, string_agg(DISTINCT stable_id, ',' ORDER BY stable_id) AS stable_room_type_ids
FROM dims WHERE coded GROUP BY ALL HAVING count(DISTINCT stable_id) > 1""", *_BASE))
def dq13(spark, sf):
    d = rooms.source_code_conflicts(rooms.room_dimension(profiles(spark, sf)))
    return d.withColumn("stable_room_type_ids", F.array_join("stable_room_type_ids", ","))


@query("DQ13_evidence_quality", sql("""
SELECT 'source-code conflicts' AS kind, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM dims WHERE coded GROUP BY hotel_id, code HAVING count(DISTINCT stable_id) > 1)) AS problems
UNION ALL SELECT 'matchable-label conflicts', 0 UNION ALL SELECT 'incomplete code-only aliases', 0""", *_BASE))
def dq13b(spark, sf):
    p = profiles(spark, sf)
    return rooms.evidence_quality(p).select("kind", "problems")


@query("DQ13_evidence_with_defects", sql("""
SELECT 'source-code conflicts' AS kind, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM dims WHERE coded AND length(name) % 2 = 1 GROUP BY hotel_id, code HAVING count(DISTINCT stable_id) > 1)) AS problems
UNION ALL SELECT 'matchable-label conflicts', (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM dims GROUP BY hotel_id, length(name) % 3 HAVING count(DISTINCT stable_id) > 1))
UNION ALL SELECT 'incomplete code-only aliases', (SELECT CAST(count(*) AS BIGINT) FROM dims WHERE coded AND length(name) % 2 = 0)""", *_BASE))
def dq13d(spark, sf):
    """Rooms share labels, and every second code-only alias has lost its source."""
    no = F.lit(None).cast("string")

    def spoiled(room):
        n = F.length(room["name_en"])
        shared = F.struct(
            F.concat(F.lit("Shared "), n % 3).alias("label"), no.alias("language"), no.alias("source_type"), no.alias("source_platform"), no.alias("room_type_code"),
            F.lit("https://example.test/rooms").alias("source_url"), F.lit("2026-09-01").alias("observed_at"), F.lit(True).alias("label_match"),
        )
        own = F.transform(room["aliases"], lambda a: a.withField("source_url", F.when(n % 2 == 0, F.lit("")).otherwise(a["source_url"])))
        return room.withField("aliases", F.concat(own, F.array(shared)))

    rooms_of = F.transform("room_snapshot.rooms", spoiled)
    p = profiles(spark, sf).withColumn("room_snapshot", F.col("room_snapshot").withField("rooms", rooms_of))
    return rooms.evidence_quality(p).select("kind", "problems")


@query("DQ14_alias_evidence", sql("""
, a AS (SELECT hotel_id, name, CASE length(name) % 5 WHEN 0 THEN 'http://plain.test' ELSE 'https://ok.test' END AS url,
          CASE length(name) % 3 WHEN 0 THEN '2026-09' ELSE '2026-09-01' END AS observed, length(name) % 2 = 0 AS code_only FROM seen)
SELECT hotel_id, CAST(count(*) FILTER (url LIKE 'https://%' AND (NOT code_only OR length(observed) = 10)) AS BIGINT) AS kept,
       CAST(count(*) FILTER (code_only AND NOT (url LIKE 'https://%' AND length(observed) = 10)) AS BIGINT) AS incomplete
FROM a GROUP BY 1""", SQL_PRICED, _PICK.format(src="priced")))
def dq14(spark, sf):
    names = observations(spark, sf).select("hotel_id", F.col("room_type_name").alias("name")).distinct()
    n, no = F.length("name"), F.lit(None).cast("string")
    alias = F.struct(
        F.col("name").alias("label"), no.alias("language"), no.alias("source_type"), F.lit("booking_com").alias("source_platform"), F.lit("R1").alias("room_type_code"),
        F.when(n % 5 == 0, F.lit("http://plain.test")).otherwise(F.lit("https://ok.test")).alias("source_url"),
        F.when(n % 3 == 0, F.lit("2026-09")).otherwise(F.lit("2026-09-01")).alias("observed_at"), (n % 2 != 0).alias("label_match"),
    )
    room = F.struct(
        no.alias("name_zh"), F.col("name").alias("name_en"), no.alias("name_ja"), F.lit(None).cast("double").alias("size_sqm"), F.lit(None).cast("double").alias("size_sqm_min"),
        F.lit(None).cast("double").alias("size_sqm_max"), F.lit(None).cast("int").alias("room_count"), F.lit(None).cast("array<string>").alias("aliases_zh"), F.array(alias).alias("aliases"),
    )
    p = names.groupBy("hotel_id").agg(F.collect_list(room).alias("rooms")).select(
        "hotel_id", F.struct(no.alias("observed_at"), no.alias("source_type"), no.alias("source_url"), "rooms").alias("room_snapshot")
    )
    kept = rooms.room_dimension(p).groupBy("hotel_id").agg(F.sum(F.size("aliases")).alias("kept"))
    bad = rooms.incomplete_code_aliases(p).groupBy("hotel_id").agg(F.count("*").alias("incomplete"))
    return kept.join(bad, "hotel_id", "left").select("hotel_id", "kept", F.coalesce("incomplete", F.lit(0)).cast("long").alias("incomplete"))


_QUALITY = SQL_TERMS.replace("{source}", "matched") + """,
q AS (
  SELECT *, breakfast_included IS NULL AS m_breakfast, size_band = 'unknown' AS m_size, cancellation_class = 'unknown' AS m_class,
         cancellation_deadline = 'unknown' AS m_deadline, tax_state = 'unknown' AS m_tax, stable_room_type_id IS NULL AS m_room FROM terms),
qq AS (
  SELECT *, NOT (m_breakfast OR m_size OR m_class OR m_deadline OR m_tax OR m_room) AS strict,
         CASE WHEN NOT (m_breakfast OR m_size OR m_class OR m_deadline OR m_tax OR m_room) THEN NULL
              WHEN m_room AND room_match_status = 'area_mismatch' THEN CASE WHEN m_breakfast OR m_size OR m_class OR m_deadline OR m_tax
                   THEN 'room_area_conflict_and_metadata' ELSE 'room_area_conflict_only' END
              WHEN m_room THEN CASE WHEN m_breakfast OR m_size OR m_class OR m_deadline OR m_tax THEN 'room_evidence_and_metadata' ELSE 'room_evidence_only' END
              ELSE 'metadata_only' END AS gap,
         room_match_status IN ('unmatched_label', 'area_mismatch', 'ambiguous_label') AS unresolved
  FROM q)
"""
_Q = (*_BASE, _QUALITY)


def graded(spark, sf):
    return matchquality.with_gap_category(with_comparison(matched(spark, sf), require_stable_room=True))


@query("DQ10_match_overview", sql("""
SELECT CAST(count(*) AS BIGINT) AS observation_count, CAST(count(stable_room_type_id) AS BIGINT) AS mapped_observations, CAST(count_if(strict) AS BIGINT) AS strict_parity_eligible_observations,
       CAST(count_if(unresolved) AS BIGINT) AS unresolved_observations, round(count(stable_room_type_id) * 1.0 / count(*), 4) AS mapped_rate, round(count_if(strict) * 1.0 / count(*), 4) AS strict_parity_eligible_rate
FROM qq""", *_Q))
def dq10(spark, sf):
    return matchquality.match_overview(graded(spark, sf))


@query("DQ10_match_per_hotel", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS observation_count, CAST(count(stable_room_type_id) AS BIGINT) AS mapped_observations, CAST(count_if(strict) AS BIGINT) AS strict_parity_eligible_observations,
       CAST(count_if(unresolved) AS BIGINT) AS unresolved_observations, round(count(stable_room_type_id) * 1.0 / count(*), 4) AS mapped_rate, round(count_if(strict) * 1.0 / count(*), 4) AS strict_parity_eligible_rate
FROM qq GROUP BY 1""", *_Q))
def dq10b(spark, sf):
    return matchquality.match_overview(graded(spark, sf), ["hotel_id"])


@query("DQ10_count_maps", sql("""
SELECT 'status' AS kind, room_match_status AS name, CAST(count(*) AS BIGINT) AS rows FROM qq GROUP BY ALL
UNION ALL SELECT 'gap_category', gap, CAST(count(*) AS BIGINT) FROM qq WHERE NOT strict GROUP BY ALL
UNION ALL SELECT 'missing_field', f, CAST(count(*) AS BIGINT) FROM (SELECT unnest(list_filter([CASE WHEN m_size THEN 'room_size' END, CASE WHEN m_room THEN 'stable_room_type_id' END,
   CASE WHEN m_breakfast THEN 'breakfast_included' END, CASE WHEN m_class THEN 'cancellation_class' END, CASE WHEN m_deadline THEN 'cancellation_deadline' END,
   CASE WHEN m_tax THEN 'tax_inclusion' END], lambda x: x IS NOT NULL)) AS f FROM qq WHERE NOT strict) GROUP BY ALL""", *_Q))
def dq10c(spark, sf):
    return matchquality.count_maps(graded(spark, sf))


_CAND = """
cand AS (SELECT hotel_id, room_match_status, room_type_name, room_type_code, source_platform, room_size_sqm, count(*) AS observations, max(queried_at) AS latest,
    count_if(gap = 'room_evidence_only') AS unlockable, count_if(gap = 'room_evidence_and_metadata') AS blocked,
    count_if(gap IN ('room_area_conflict_only', 'room_area_conflict_and_metadata')) AS area_conflict
  FROM qq WHERE unresolved GROUP BY ALL)
"""


@query("DQ11_top_candidates", sql("""
SELECT hotel_id, room_match_status, room_type_name, room_type_code, source_platform, round(room_size_sqm, 2) AS room_size_sqm, CAST(observations AS BIGINT) AS observations,
       strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_queried_at, CAST(unlockable AS BIGINT) AS unlockable, CAST(blocked AS BIGINT) AS blocked, CAST(area_conflict AS BIGINT) AS area_conflict,
       CAST(row_number() OVER (PARTITION BY hotel_id ORDER BY observations DESC, source_platform, room_type_name, room_type_code, room_match_status, room_size_sqm NULLS FIRST) AS INTEGER) AS position
FROM cand QUALIFY position <= 8""", *_Q, _CAND))
def dq11(spark, sf):
    d = matchquality.top_candidates(matchquality.unresolved_candidates(graded(spark, sf)))
    return d.drop("sample_source_url").withColumns({"room_size_sqm": r("room_size_sqm", 2), "latest_queried_at": ts("latest_queried_at")})


def _reviews(spark, sf):
    """Reviews of the labels that end in 'gear', and of one label nobody shows."""
    c = matchquality.unresolved_candidates(graded(spark, sf)).where("room_type_name like '%gear'")
    base = c.select("hotel_id", "source_platform", "room_type_code", "room_type_name", "room_size_sqm").distinct()
    gone = observations(spark, sf).select("hotel_id").distinct().select(
        "hotel_id", F.lit("booking_com").alias("source_platform"), F.lit("R9").alias("room_type_code"), F.lit("gone room").alias("room_type_name"),
        F.lit(40).cast("decimal(18,4)").alias("room_size_sqm"),
    )
    return base.unionByName(gone).withColumns(
        {
            "status": F.lit("blocked_ambiguous_label"), "reviewed_at": F.lit("2026-09-30"),
            "evidence_urls": F.array(F.lit("https://example.test")), "note": F.lit("seen"),
        }
    )


@query("DQ12_mapping_priority", sql("""
SELECT hotel_id, CAST(sum(unlockable) AS BIGINT) AS unlockable, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(count(*) AS BIGINT) AS candidates
FROM cand WHERE room_type_name NOT LIKE '%gear' AND (unlockable > 0 OR blocked > 0) GROUP BY 1""", *_Q, _CAND))
def dq12(spark, sf):
    return matchquality.mapping_priority(matchquality.unresolved_candidates(graded(spark, sf)), _reviews(spark, sf))


@query("DQ12_reviewed_candidates", sql("""
SELECT hotel_id, source_platform, room_type_code, room_type_name, room_match_status, CAST(observations AS BIGINT) AS observations FROM cand WHERE room_type_name LIKE '%gear'""", *_Q, _CAND))
def dq12b(spark, sf):
    d = matchquality.reviewed_candidates(matchquality.unresolved_candidates(graded(spark, sf)), _reviews(spark, sf))
    return d.where("review_status is not null").select("hotel_id", "source_platform", "room_type_code", "room_type_name", "room_match_status", "observations")


@query("DQ12_stale_room_reviews", sql("SELECT DISTINCT hotel_id, 'gone room' AS room_type_name FROM rates"))
def dq12c(spark, sf):
    d = matchquality.stale_room_reviews(matchquality.unresolved_candidates(graded(spark, sf)), _reviews(spark, sf))
    return d.select("hotel_id", "room_type_name")


@query("DQ12_strict_gap_hotels", sql("""
SELECT hotel_id, concat('Hotel ', substr(hotel_id, 7)) AS hotel_name, city, CAST(count(*) AS BIGINT) AS observations, CAST(count_if(strict) AS BIGINT) AS strict_parity_eligible_observations,
       CAST(count_if(NOT strict) AS BIGINT) AS strict_parity_gap_observations, string_agg(DISTINCT source_platform, ',' ORDER BY source_platform) AS source_platforms,
       CAST(count_if(gap LIKE 'room_area_conflict%') AS BIGINT) AS area_conflict
FROM qq GROUP BY hotel_id, city HAVING count_if(NOT strict) > 0""", *_Q))
def dq12d(spark, sf):
    return matchquality.strict_gap_hotels(graded(spark, sf))
