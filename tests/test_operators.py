"""Operators against literal cases and brute force."""

import random
import statistics
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from registered import view
from ratelens.operators import dedup, health, market, matchquality, parity, planning, quality, rooms, stats
from ratelens.operators.containment import contained_labels
from ratelens.operators.parity import with_comparison, with_terms
from ratelens.session import cut_lineage


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("n,hot", [(1, False), (2, False), (997, False), (4000, True)])
def test_grouped_stats_is_exact(spark, n, hot):
    rnd = random.Random(n)
    data = [("hot" if hot and i % 3 else rnd.choice(["a", "b", None]), float(rnd.choice([rnd.randint(-50, 50), rnd.uniform(0, 2e6), 0]))) for i in range(n)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    got = {r.g: r for r in stats.grouped_stats(df, ["g"], {"v": "v"}).collect()}
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].v_n == len(vs)
        assert got[g].v_median == pytest.approx(statistics.median(vs), abs=1e-9)
        assert got[g].v_mean == pytest.approx(statistics.fmean(vs), rel=1e-9, abs=1e-9)
        assert (got[g].v_min, got[g].v_max) == (min(vs), max(vs))


def test_several_values_and_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", nan, 7.0), ("c", None, nan)], "g string, x double, y double")
    counts = stats.grouped_stats(df, ["g"], {"x": "x", "y": "y"}).fillna(-1)
    assert rows_of(counts, "g", "x_n", "y_n") == [("a", 2, 1), ("b", -1, 1)]
    assert rows_of(stats.grouped_medians(df, ["g"], {"x": "x", "y": "y"}).fillna(-1), "g", "x", "y") == [("a", 2.0, 5.0), ("b", -1.0, 7.0)]


def test_natural_key_aliases_and_defaults(make):
    d = dedup.with_natural_key(
        make(
            {"queried_at": "2026-10-08T01:00:00Z"}, {"queried_at": "2026-10-08T23:00:00+00:00", "source_platform": " OFFICIAL ", "currency": "ntd"},
            {"source_platform": None, "rooms": None, "adults": None, "children": None},
        )
    )
    assert d.select(*dedup.KEY_COLUMNS).distinct().count() == 1
    other = make({"adults": 1}, {"room_type_code": None}, {"check_out": "2026-12-04"}, {"currency": "USD"}, {"queried_at": "2026-10-09T00:00:00Z"}, {"rate_plan_code": ""}, {"hotel_id": "h2"})
    assert dedup.with_natural_key(other).select(*dedup.KEY_COLUMNS).distinct().count() == 7


def test_dedup_keeps_newest_and_is_idempotent(make):
    d = make({"queried_at": "2026-10-08T01:00:00Z", "total_price": 1}, {"queried_at": "2026-10-08T09:00:00Z", "total_price": 2}, {"queried_at": "2026-10-08T03:00:00Z", "total_price": 3})
    once = dedup.deduplicate(d)
    assert [int(r.total_price) for r in once.collect()] == [2]
    assert dedup.deduplicate(once).count() == 1
    assert [int(r.total_price) for r in dedup.deduplicate(d, keep="first").collect()] == [1]
    with pytest.raises(ValueError):
        dedup.deduplicate(d, keep="any")


def test_copies_of_one_key_are_cut_before_the_shuffle(make):
    plan = dedup.deduplicate(make({}))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_dedup_moves_a_digest_of_the_key_and_not_its_texts(make):
    plan = dedup.deduplicate(make({}))._jdf.queryExecution().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert moved and all("_digest" in line and "key_hotel" not in line for line in moved)


def test_dedup_tells_key_parts_apart(make):
    d = make(
        {"hotel_id": "a", "room_type_code": "b|c"}, {"hotel_id": "a|b", "room_type_code": "c"}, {"hotel_id": 'a","key_room":"', "room_type_code": "c"},
        {"hotel_id": None}, {"hotel_id": ""}, {"hotel_id": None},
    )
    assert rows_of(dedup.deduplicate(d), "observation_id") == [("o0",), ("o1",), ("o2",), ("o5",)]


def test_rates_are_read_in_small_splits(spark, tmp_path):
    """The rows of a split are sorted by one task, some 20 times their size in the file."""
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.range(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        spark.conf.set(name, "134217728b")
        view.table(spark, str(tmp_path), "lineitem")
        assert spark.conf.get(name) == "32m"
    finally:
        spark.conf.set(name, was)


def test_latest_batch_rules(make):
    d = make(
        {"hotel_id": "w", "queried_at": "2026-09-07T03:31:00Z"}, {"hotel_id": "w", "queried_at": "2026-09-07T22:09:00Z"}, {"hotel_id": "w", "queried_at": "2026-09-07T22:11:00Z"},
        {"hotel_id": "w", "run_id": "early", "queried_at": "2026-09-07T22:05:00Z"},
        {"hotel_id": "r", "run_id": "old", "queried_at": "2026-09-07T22:09:00Z"}, {"hotel_id": "r", "run_id": "new", "queried_at": "2026-09-07T22:10:00Z"}, {"hotel_id": "r", "run_id": "new", "queried_at": "2026-09-07T23:01:00Z"},
        {"hotel_id": "r", "run_id": "x", "source_platform": "booking_com", "queried_at": "2026-09-01T00:00:00Z"},
    )
    assert rows_of(dedup.latest_batches(d), "observation_id") == [("o1",), ("o2",), ("o5",), ("o6",), ("o7",)]
    assert ("o3",) in rows_of(dedup.latest_batches(d, strict_legacy=False), "observation_id")


def test_market_summary_is_equal_weighted(make):
    d = make(
        {"hotel_id": "a", "total_price": 100}, {"hotel_id": "a", "total_price": 300}, {"hotel_id": "b", "total_price": 1000}, {"hotel_id": "c", "total_price": 5000},
        {"hotel_id": "c", "total_price": 99999, "source_platform": "booking_com"}, {"hotel_id": "d", "total_price": 0}, {"hotel_id": None, "total_price": 7}, price=True,
    )
    r = market.market_summary(d).first()
    assert (r.observations, r.hotels, r.median_adr_twd, r.average_adr_twd, r.median_cpi_adjusted_twd) == (6, 4, 1000.0, 2067.0, None)


def _weeks(make):
    rows = []
    for day, hotel, values in (("2026-09-10", "a", (8000, 12000)), ("2026-09-10", "b", (20000,)), ("2026-09-17", "a", (10000, 14000)), ("2026-09-17", "b", (24000,))):
        rows += [{"hotel_id": hotel, "queried_at": f"{day}T0{i}:00:00Z", "lead_days": 30 if i else 7, "total_price": v} for i, v in enumerate(values)]
    return make(*rows, price=True)


def test_weekly_digest(make):
    r = market.weekly_digest(_weeks(make)).first()
    assert (r.available, r.current_market_median_twd, r.previous_market_median_twd, r.change_pct) == (True, 18000.0, 15000.0, 0.2)
    assert (r.comparable_hotels, r.current_hotels, r.current_observations, r.previous_observations) == (2, 2, 3, 3)
    assert rows_of(market.weekly_movers(_weeks(make)), "hotel_id", "change_pct") == [("a", 0.2), ("b", 0.2)]
    assert rows_of(market.lead_time_curve(_weeks(make)), "lead_days") == [(7,), (30,)]


def test_weekly_digest_without_history(make):
    r = market.weekly_digest(_weeks(make).where("false")).first()
    assert (r.available, r.reason, r.change_pct) == (False, "no_history", None)
    assert (r.current_end, r.comparable_hotels) == (None, 0)


def test_weekly_change_is_unknown_without_a_previous_week(make):
    r = market.weekly_digest(_weeks(make).where("queried_at > '2026-09-15'")).first()
    assert (r.available, r.change_pct, r.comparable_hotels) == (True, None, 0)


def test_daily_digest(make):
    rows = [
        {"hotel_id": h, "queried_at": f"{d}T01:00:00Z", "check_in": "2026-10-07", "check_out": "2026-10-08", "total_price": v, "stable_room_type_id": f"rt_{h}"}
        for d, h, v in (("2026-09-23", "a", 10000), ("2026-09-23", "b", 20000), ("2026-09-30", "a", 12000), ("2026-09-30", "b", 18000))
    ]
    rows.append({**rows[2], "source_platform": "booking_com", "total_price": 12300})
    d = cut_lineage(make(*rows, price=True), "test-daily-digest")
    r = market.daily_digest(d, with_comparison(with_terms(d), require_stable_room=True)).first()
    assert (r.core_adr_change_pct, r.largest_increase_hotel, r.largest_decrease_hotel, r.parity_normal_rate, r.parity_products) == (0.0, "a", "b", 1.0, 1)


def test_rollup_core_median(make):
    d = make({"total_price": 10000, "room_size_sqm": 50}, {"total_price": 14000, "room_size_sqm": 90}, {"total_price": 12000, "room_size_sqm": None}, price=True)
    r = market.history_rollup(d, "hotel").first()
    assert (r.observations, r.average_twd, r.median_twd, r.core_median_twd, r.days) == (3, 12000.0, 12000.0, 10000.0, 1)
    assert {x.grain for x in market.history_rollups(d).select("grain").collect()} == {"daily", "hotel", "lead"}


def _keyed(make, *rows):
    base = {"stable_room_type_id": "rt_1"}
    termed = cut_lineage(with_terms(make(*[{**base, **r} for r in rows], price=True)), f"test-{uuid.uuid4().hex}")
    return with_comparison(termed, require_stable_room=True)


OTA = {"source_platform": "booking_com", "total_price": 11000}


def test_parity_pairs_the_nearest_batch(make):
    k = _keyed(
        make, {"queried_at": "2026-10-01T01:00:00Z", "total_price": 7000}, {"queried_at": "2026-10-08T01:00:00Z"},
        {**OTA, "queried_at": "2026-10-08T12:00:00Z"}, {**OTA, "queried_at": "2026-10-12T12:00:00Z", "total_price": 13000},
    )
    (r,) = parity.rate_parity(k).collect()
    assert (r.official_median_twd, r.ota_median_twd, round(r.gap_percent, 9), r.query_time_gap_hours) == (10000.0, 11000.0, 0.1, 11.0)


# Each case is a hotel of its own, so that one run judges them all.
BOUND = {"2026-10-09T01:00:00Z": True, "2026-10-09T01:00:01Z": False, "2026-10-07T01:00:00Z": True, "2026-10-07T00:59:59Z": False, None: False}
CHANGES = (
    {"check_out": "2026-12-04"}, {"rooms": 2}, {"adults": 1}, {"stable_room_type_id": "rt_2"}, {"breakfast_included": False},
    {"cancellation_policy": "Non-refundable"}, {"tax_inclusion": "excluded"}, {"stable_room_type_id": None},
)


def test_parity_bound_is_inclusive_and_conditions_must_agree(make):
    rows, want = [], set()
    for i, (stamp, paired) in enumerate(BOUND.items()):
        rows += [{"hotel_id": f"t{i}"}, {**OTA, "hotel_id": f"t{i}", "queried_at": stamp}]
        want |= {f"t{i}"} if paired else set()
    for i, change in enumerate(CHANGES):
        rows += [{"hotel_id": f"c{i}"}, {**OTA, "hotel_id": f"c{i}", **change}]
    # Three prices at one instant take the counted median.
    rows += [{"hotel_id": "m"}, *({**OTA, "hotel_id": "m", "total_price": p} for p in (20000, 11000, 9000))]
    rows += [{"hotel_id": "n", "check_out": "2026-12-03", "total_price": 24000}, {**OTA, "hotel_id": "n", "check_out": "2026-12-03", "total_price": 26000}]
    got = {r.hotel_id: r for r in parity.rate_parity(_keyed(make, *rows)).collect()}
    assert set(got) == want | {"m", "n"}
    assert got["m"].ota_median_twd == 11000.0
    assert (got["n"].official_median_twd, got["n"].ota_median_twd, round(got["n"].gap_percent, 9)) == (12000.0, 13000.0, round(1 / 12, 9))


def test_parity_against_brute_force(spark):
    rnd = random.Random(7)
    t0 = datetime(2026, 1, 1)
    data = {(f"k{rnd.randint(0, 5)}", rnd.choice(["official", "x", "y"]), t0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 40))) for _ in range(400)}
    df = spark.createDataFrame(sorted(data), "comparison_key string, source string, ts timestamp")
    got = {(r.comparison_key, r.other_source): (r.other_ts, r.official_ts) for r in parity.newest_valid_pairs(df, 6 * 3600).collect()}
    want = {}
    for k in {d[0] for d in data}:
        off = [d[2] for d in data if d[0] == k and d[1] == "official"]
        for s in ("x", "y"):
            for ts in sorted((d[2] for d in data if d[0] == k and d[1] == s), reverse=True):
                near = min(off, key=lambda o: (abs(o - ts), -o.timestamp()), default=None)
                if near is not None and abs(near - ts) <= timedelta(hours=6):
                    want[k, s] = (ts, near)
                    break
    assert got == want


def test_missing_fields_in_fixed_order(make):
    k = _keyed(make, {"stable_room_type_id": None, "breakfast_included": None, "cancellation_policy": "See page", "tax_inclusion": "unknown"})
    assert k.first().missing_fields == ["stable_room_type_id", "breakfast_included", "cancellation_class", "cancellation_deadline", "tax_inclusion"]
    assert k.first().comparison_status == "insufficient_product_metadata"


def test_group_id(spark):
    assert spark.range(1).select(parity.comparison_group_id(F.lit("same-product"))).first()[0] == "6966aafb2ab4821d"


def _dimension(spark, *room_rows):
    cols = "hotel_id string, stable_room_type_id string, normalized_room_family string, room_class string, name_zh string, name_en string, name_ja string, aliases_zh array<string>, size_sqm_min double, size_sqm_max double"
    return spark.createDataFrame(room_rows, cols).withColumn("aliases", F.array().cast(f"array<{rooms.ALIAS}>"))


def test_room_match_cases(spark, make):
    dim = _dimension(
        spark, ("a", "rt_king", "room:55", "room", "豪華客房（一大床）", "Deluxe Room – King", None, ["豪華大床房"], 55.0, 55.0), ("a", "rt_sup", "room:48", "room", "卓越客房", "Superior Room", None, [], 48.0, 48.0),
        ("b", "rt_any", "room:48", "room", None, "Room", None, [], 48.0, 48.0), ("c", "rt_1", "room:30", "room", None, "Twin Room", None, [], 30.0, 30.0), ("c", "rt_2", "room:31", "room", None, "Twin Room", None, [], 31.0, 31.0),
    )
    cases = [
        ("a", "Deluxe Room - King", 55, "rt_king", "matched_exact_evidenced_label"), ("a", "Deluxe Room - King", 80, None, "area_mismatch"),
        ("a", "Deluxe Room - King, City View", 56, "rt_king", "matched_evidenced_label_with_descriptors"), ("a", "卓越客房一大床", 48, "rt_sup", "matched_evidenced_label_with_descriptors"),
        ("a", "卓越客房一大床", None, None, "unmatched_label"), ("b", "Room with city view", 48, None, "unmatched_label"), ("a", "", 48, None, "missing_room_type_name"),
        ("c", "Twin Room", None, None, "ambiguous_label"), ("c", "twin room", 32, "rt_2", "matched_exact_evidenced_label"),
    ]
    d = make(*[{"hotel_id": h, "room_type_name": n or None, "room_size_sqm": s, "room_type_code": None} for h, n, s, _, _ in cases])
    got = [(r.stable_room_type_id, r.room_match_status) for r in rooms.match_rooms(d, dim).orderBy("observation_id").collect()]
    assert got == [c[3:] for c in cases]


@pytest.fixture
def few_broadcast(spark):
    """Small broadcasts and many shuffle partitions, as with tables of many GB."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _stays_spread(df):
    """Each task has the rows of one input split, and no join was planned that deals them out."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max(F.hash("*"))).collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(r.n for r in tasks) == 8000 and max(r.n for r in tasks) == 1000 and "SortMergeJoin" not in plan


def test_rows_of_one_room_stay_spread(spark, few_broadcast):
    dim = _dimension(spark, ("a", "rt_king", "room:55", "room", None, "Deluxe Room", None, [], 55.0, 55.0))
    d = spark.range(0, 8000, 1, 8).select("id", F.lit("a").alias("hotel_id"), F.lit("official").alias("source_platform"), F.lit("K").alias("room_type_code"), F.lit("deluxe room").alias("room_type_name"), F.lit(55.0).alias("room_size_sqm"))
    out = rooms.match_rooms(d, dim)
    assert out.where("stable_room_type_id = 'rt_king'").count() == 8000
    assert _stays_spread(out)


def test_rows_of_one_stream_stay_spread(spark, few_broadcast):
    d = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("observation_id"), F.when(F.col("id") >= 0, F.lit("a")).alias("hotel_id"), F.lit("official").alias("source_platform"), F.lit("run").alias("run_id"), F.timestamp_seconds("id").alias("queried_at"))
    assert _stays_spread(dedup.latest_batches(d))


def _profile(spark, alias):
    schema = f"hotel_id string, room_snapshot struct<observed_at:string,source_type:string,source_url:string,rooms:array<{rooms.ROOM}>>"
    room = ("精緻套房", "Junior Suite", None, 65.0, None, None, None, None, [alias])
    return spark.createDataFrame([("a", ("2026-10-18", "official", "https://o.test", [room]))], schema)


def _alias(label="小型套房", code=None, url="https://x.test", at="2026-10-14", match=None, source="booking_com"):
    return (label, "zh", "ota", source, code, url, at, match)


def test_alias_is_matchable_and_code_beats_label(spark, make):
    dim = rooms.room_dimension(_profile(spark, _alias(code="B1", match=False)))
    d = make({"hotel_id": "a", "source_platform": "booking_com", "room_type_code": "B1", "room_type_name": "Whatever", "room_size_sqm": 65}, {"hotel_id": "a", "room_type_name": "小型套房", "room_type_code": None, "room_size_sqm": 65})
    got = [r.room_match_status for r in rooms.match_rooms(d, dim).orderBy("observation_id").collect()]
    assert got == ["matched_evidenced_source_code", "unmatched_label"]
    labelled = rooms.room_dimension(_profile(spark, _alias()))
    assert rooms.match_rooms(d, labelled).where("observation_id = 'o1'").first().room_match_status == "matched_exact_evidenced_label"


def test_incomplete_code_alias_fails_the_gate(spark):
    p = _profile(spark, _alias(code=None, match=False, at="October 23"))
    assert rooms.incomplete_code_aliases(p).first().missing_fields == ["room_type_code", "observed_at"]
    assert rooms.room_dimension(p).first().aliases == []
    with pytest.raises(ValueError, match="1 incomplete code-only aliases"):
        rooms.assert_room_integrity(p)
    rooms.assert_room_integrity(_profile(spark, _alias()))


def test_volume_and_price_warnings(make):
    rows = [{"queried_at": f"2026-09-{30 - i:02d}T01:00:00Z", "total_price": 10000} for i in range(1, 8) for _ in range(10)]
    rows += [{"queried_at": "2026-09-30T01:00:00Z", "total_price": 20000}] * 4
    rows += [{"hotel_id": "gone", "queried_at": "2026-09-29T01:00:00Z"}]
    got = rows_of(quality.volume_warnings(make(*rows, price=True)), "hotel_id", "code")
    assert got == [("gone", "low_volume"), ("h1", "low_volume"), ("h1", "price_spike")]


def test_match_quality_categories(make, spark):
    k = _keyed(make, {}, {"stable_room_type_id": None}, {"stable_room_type_id": None, "breakfast_included": None}, {"breakfast_included": None})
    d = k.withColumn("room_match_status", F.when(F.col("stable_room_type_id").isNull(), F.lit("unmatched_label")).otherwise(F.lit("matched_exact_evidenced_label")))
    g = matchquality.with_gap_category(d)
    assert rows_of(g.fillna("none", ["gap_category"]), "observation_id", "gap_category") == [("o0", "none"), ("o1", "room_evidence_only"), ("o2", "room_evidence_and_metadata"), ("o3", "metadata_only")]
    r = matchquality.match_overview(g).first()
    assert (r.observation_count, r.mapped_rate, r.strict_parity_eligible_rate) == (4, 0.5, 0.25)
    assert matchquality.match_overview(g.where("false")).first().mapped_rate is None


def _attempts(spark, *rows):
    return spark.createDataFrame(
        [("web", "h", datetime(2026, 9, 24) + timedelta(minutes=m), i, outcome, code, ms, reason) for i, (m, outcome, code, ms, reason) in enumerate(rows)],
        "adapter string, hotel_id string, ts timestamp, seq long, outcome string, status_code int, duration_ms double, reason string",
    )


def test_backoff_and_reset(spark):
    r = health.health_state(_attempts(spark, (0, "failure", None, 10.0, "x"), (1, "failure", None, 20.0, "x"))).first()
    assert (r.consecutive_failures, r.last_status, r.cooldown_until) == (2, "failed", datetime(2026, 9, 24, 6, 1))
    r = health.health_state(_attempts(spark, (0, "failure", None, 10.0, "x"), (1, "empty", None, 20.0, ""), (2, "empty", None, 30.0, ""), (3, "success", None, 40.0, ""))).first()
    assert (r.attempts, r.failures, r.empty_responses, r.consecutive_failures, r.cooldown_until, r.success_rate, r.average_response_ms) == (4, 1, 2, 0, None, 0.5, 25.0)


def test_blocked_exponent_never_resets_and_is_capped(spark):
    rows = [(i, "failure" if i % 2 == 0 else "success", None, 1.0, "HTTP 403 for ?token=abc") for i in range(9)]
    d = health.attempt_states(_attempts(spark, *rows)).where("is_failure").orderBy("seq").collect()
    assert [r.cooldown_minutes for r in d] == [1440.0, 2880.0, 5760.0, 10080.0, 10080.0]
    assert all("abc" not in r.safe_reason for r in d)


def test_running_state_carries_over_chunks(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 3000), rnd.choice(["failure", "failure", "success", "empty"]), rnd.choice([None, None, 403]), 1.0, "") for _ in range(200)]
    d = health.attempt_states(_attempts(spark, *rows)).orderBy("ts", "seq").collect()
    streak = blocked = 0
    for r in d:
        streak = streak + 1 if r.is_failure else 0
        blocked += r.is_blocked
        assert r.blocked_count == blocked
        if r.is_failure:
            assert r.consecutive_failures == streak


def test_lead_days_and_local_sunday(spark):
    assert planning.parse_lead_days("1, 7") == (1, 7)
    for bad in ("", "0,7"):
        with pytest.raises(ValueError):
            planning.parse_lead_days(bad)
    d = spark.createDataFrame([("2026-09-06 20:00:00", "Asia/Taipei"), ("2026-09-06 20:00:00", "America/New_York")], "t string, z string")
    got = [str(r[0]) for r in d.select(planning.local_date(F.col("t").cast("timestamp"), F.col("z"))).collect()]
    assert got == ["2026-09-07", "2026-09-06"]


def test_scalar_rows_must_be_single(spark):
    with pytest.raises(Exception):
        stats.beside(spark.range(1), spark.range(2)).collect()


def test_plan_fills_the_defaults_of_a_hotel_record(spark):
    hotels = spark.createDataFrame([("h1", "a", True, None, None, None), ("h2", "a", None, "Asia/Tokyo", None, "supplemental"), ("h3", "a", True, "Nowhere/None", "daily", "core")], "hotel_id string, adapter string, enabled boolean, timezone string, collection_frequency string, market_scope string")
    requests, failures = planning.collection_plan(hotels, (7, 14), F.lit("2026-10-08 01:00:00").cast("timestamp"), F.lit("r"))
    assert rows_of(requests, "hotel_id", "lead_days") == [("h1", 7), ("h1", 14), ("h2", 14)]
    assert rows_of(failures, "hotel_id") == [("h3",)]


def test_contained_labels(spark):
    """One text of 5,000 characters and labels of 1,000 lengths, against brute force."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdé房") for _ in range(5000))
    labels = {text[i * 3 : i * 3 + i] for i in range(1, 1001)} | {"".join(rng.choice("abcdé房") for _ in range(n)) for n in range(1, 60)} | {"", "xyz", "a", "ab"}
    texts = [("h", text), ("h", "abc"), ("h", "a"), ("h", ""), ("h", None), (None, "abc"), ("g", "abcab"), ("h", "abc")]
    filed = [("h", x) for x in labels] + [("g", "ca"), ("g", None), (None, "a"), ("h", "ab")]
    got = contained_labels(spark.createDataFrame(texts, "hotel string, t string"), spark.createDataFrame(filed, "hotel string, x string"), ["hotel"], "t", "x")
    want = {(h, t, x) for h, t in texts for g, x in filed if h and h == g and t and x and x in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_rollups_in_one_scan(spark, make):
    days = [("h1", "2026-10-01", 1, 9000, 50), ("h1", "2026-10-01", 7, 11000, 50), ("h1", "2026-10-02", 1, 9000, 30), ("h2", "2026-10-02", None, 7000, None)]
    d = make(*({"hotel_id": h, "queried_at": f"{q}T01:00:00Z", "lead_days": n, "total_price": p, "room_size_sqm": s} for h, q, n, p, s in days), price=True)
    got = {(r.grain, r.hotel_id, str(r.day), r.lead_days): (r.observations, r.median_twd, r.core_median_twd, r.days) for r in market.history_rollups(d).collect()}
    assert got == {
        ("daily", "h1", "2026-10-01", None): (2, 10000.0, 10000.0, None), ("daily", "h1", "2026-10-02", None): (1, 9000.0, None, None), ("daily", "h2", "2026-10-02", None): (1, 7000.0, None, None),
        ("hotel", "h1", "None", None): (3, 9000.0, 10000.0, 2), ("hotel", "h2", "None", None): (1, 7000.0, None, 1),
        ("lead", "h1", "None", 1): (2, 9000.0, 9000.0, None), ("lead", "h1", "None", 7): (1, 11000.0, 11000.0, None),
    }
    # Two days' cubes add up to the cube of both.
    cubes = [market.history_cube(d.where(F.to_date("queried_at") == x), ["day", "lead_days"]) for x in ("2026-10-01", "2026-10-02")]
    assert sorted(map(str, market.rollups_of_cube(cubes[0].unionByName(cubes[1])).collect())) == sorted(map(str, market.history_rollups(d).collect()))
    path = spark.conf.get("spark.sql.warehouse.dir") + "/rollup-scan-" + uuid.uuid4().hex
    d.write.parquet(path)
    out = market.history_rollups(spark.read.parquet(path))
    assert len(out.collect()) == 7
    final = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
