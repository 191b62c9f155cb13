"""The end-to-end jobs on a handful of rows."""

import pytest
from pyspark.sql import functions as F

from ratelens.operators import rooms
from ratelens.plans import collection, publish, warehouse
from ratelens.schema import RATE_SCHEMA


def _profiles(spark):
    schema = f"hotel_id string, room_snapshot struct<observed_at:string,source_type:string,source_url:string,rooms:array<{rooms.ROOM}>>"
    room = (None, "Deluxe", None, 50.0, None, None, None, None, [])
    return spark.createDataFrame([("h1", ("2026-10-01", "official", "https://o.test", [room]))], schema)


def test_publish(spark, make, tmp_path):
    history = make(
        {"queried_at": "2026-10-08T01:00:00Z"}, {"queried_at": "2026-10-08T02:00:00Z", "total_price": 12000}, {"queried_at": "2026-10-01T01:00:00Z"},
        {"status": "demo"}, {"total_price": 100}, {"source_platform": None, "room_type_name": "Other", "rate_plan_code": "P2", "queried_at": "2026-10-08T02:30:00Z"},
    )
    snap = make({"source_platform": "booking_com", "source_method": "visible_browser_snapshot", "source_property_id": "p", "source_url": "https://x.test", "total_price": 13000, "queried_at": "2026-10-08T05:00:00Z"})
    p = publish.publish(history, _profiles(spark), snap)
    assert p.rows.count() == 4
    assert {r.room_match_status for r in p.rows.collect()} == {"matched_exact_evidenced_label", "unmatched_label"}
    (gap,) = p.tables["rate_parity"].collect()
    assert (gap.official_median_twd, gap.ota_median_twd, gap.query_time_gap_hours) == (12000.0, 13000.0, 3.0)
    assert p.tables["market_summary"].first().observations == 3
    assert p.tables["latest_summary"].first().record_count == 3
    index = publish.write_published(publish.Published(p.rows, p.latest, {k: p.tables[k] for k in ("weekly_digest", "top_candidates")}), str(tmp_path))
    assert index.agg(F.sum("observations")).first()[0] == 4
    assert sorted(x.name for x in tmp_path.iterdir()) == ["rates", "rates_index", "shard_index", "shards", "top_candidates", "weekly_digest"]
    for name in ("rates_index", "shard_index"):  # every listed path opens and holds what the index says
        for f in spark.read.json(str(tmp_path / name)).collect():
            body = (tmp_path / f.path).read_bytes()
            assert (body.count(b"\n"), len(body)) == (f.observations, f.bytes)


def test_a_bad_snapshot_stops_the_job(spark, make):
    bad = make({"source_platform": "official", "source_method": "visible_browser_snapshot"})
    with pytest.raises(Exception, match="official_source"):
        publish.publish(make({}), _profiles(spark), bad)


def test_warehouse_profile(spark, make, tmp_path):
    root = str(tmp_path / "w")
    warehouse.build(make({"cancellation_policy": "ask"}, {"hotel_id": "h2", "room_size_sqm": None}), root)
    reviews = spark.createDataFrame(
        [("h1", "official", ["cancellation_deadline", "cancellation_class"], "blocked_source_shell", "2026-10-01", ["https://x.test"], "n"), ("h3", "official", ["tax_inclusion"], "blocked_source_shell", "2026-10-01", ["https://x.test"], "n")],
        "hotel_id string, source_platform string, missing_fields array<string>, status string, reviewed_at string, evidence_urls array<string>, note string",
    )
    t = warehouse.profile(spark, root, reviews)
    whole = t["completeness"].where("grain = 'all'").first()
    assert (whole.rows, whole.hotels, whole.known_room_size_rows) == (2, 2, 1)
    assert {(r.hotel_id, r.disposition) for r in t["review_outcome"].collect()} == {("h1", "reviewed"), ("h2", "actionable")}
    assert [r.hotel_id for r in t["stale_reviews"].collect()] == ["h3"]
    assert t["unknown_policies"].first().reason == "unparsed_policy"


def test_collection(spark, make, tmp_path):
    hotels = spark.createDataFrame(
        [("h1", "web", True, "Asia/Taipei", "daily", "core", "d1"), ("h2", "web", True, "Asia/Taipei", "daily", "core", "d2"), ("h3", "web", True, "No/Zone", "daily", "core", "d3")],
        "hotel_id string, adapter string, enabled boolean, timezone string, collection_frequency string, market_scope string, district string",
    )
    attempts = spark.sql("SELECT 'web' AS adapter, 'h2' AS hotel_id, TIMESTAMP '2026-10-08 00:00:00' AS ts, 1L AS seq, 'failure' AS outcome, 403 AS status_code, 1.0D AS duration_ms, '' AS reason")
    at, run = F.lit("2026-10-08 18:00:00").cast("timestamp"), F.lit("run-9")
    req, failed = collection.requests(hotels, attempts, "1,7", at, run)
    assert sorted((r.hotel_id, r.lead_days, str(r.check_in)) for r in req.collect()) == [("h1", 1, "2026-10-10"), ("h1", 7, "2026-10-16")]
    assert sorted(r.hotel_id for r in failed.collect()) == ["h2", "h3"]
    assert collection.store(make({"district": None, "queried_at": "2026-10-08T18:05:00Z"}), hotels, str(tmp_path / "h"), at, run) == 1
    back = spark.read.json(str(tmp_path / "h")).first()
    assert (back.run_id, back.district, back.lead_days) == ("run-9", "d1", 53)
    assert {f.name for f in RATE_SCHEMA.fields} >= {"run_id", "district"}
