"""Sources, sinks and streams on temporary folders."""

import hashlib
import json
import os
import random
import shutil
import statistics
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratelens.operators.parity import with_terms
from ratelens.operators import health, quality
from ratelens.session import cut_lineage, shared_folder
from ratelens.sinks import history, mirror, packing, publish
from ratelens.sources import observations as src
from ratelens.sources.payloads import availability_observations
from ratelens.sources.snapshots import validate_snapshots
from ratelens.streaming.health import health_stream
from ratelens.streaming import ingest
from ratelens.streaming.ingest import latest_days, read_latest, start_ingest, start_latest
from ratelens.streaming.market import collection_sessions, start_rollups
from ratelens.streaming.medians import median_stream


def write_shards(root, shards):
    for name, lines in shards.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(lines) + "\n", encoding="utf-8")


def line(i, **kw):
    return json.dumps({"observation_id": f"o{i}", "hotel_id": "h1", "queried_at": "2026-09-01T01:00:00Z", "check_in": "2026-10-01", "check_out": "2026-10-02", "total_price": "9000", "currency": "TWD", **kw})


def test_shards_are_discovered_and_typed(spark, tmp_path):
    write_shards(tmp_path, {"2026-08.jsonl": [line(1, total_price=5000.5), ""], "2026-09/2026-09-01.jsonl": [line(2, room_size_sqm="bad")], "2026-09/notes.jsonl": [line(3)], "other.jsonl": [line(4)], "2026-09/deep/2026-09-02.jsonl": [line(5)]})
    rows = {r.observation_id: r for r in src.read_observations(spark, str(tmp_path)).collect()}
    assert set(rows) == {"o1", "o2"}
    assert float(rows["o1"].total_price) == 5000.5 and float(rows["o2"].total_price) == 9000 and rows["o2"].room_size_sqm is None


def test_malformed_line_names_the_shard(spark, tmp_path):
    write_shards(tmp_path, {"2026-09/2026-09-01.jsonl": [line(1), "{broken"]})
    with pytest.raises(Exception, match=r"2026-09-01.jsonl.*\{broken"):
        src.read_observations(spark, str(tmp_path)).collect()
    bad = src.malformed_lines(spark, str(tmp_path)).collect()
    assert [b.line for b in bad] == ["{broken"] and bad[0].shard.endswith("2026-09-01.jsonl")
    assert src.read_observations(spark, str(tmp_path), strict=False).count() == 1


def test_append_is_idempotent(spark, make, tmp_path):
    path = str(tmp_path / "h")
    d = make({"queried_at": "2026-10-08T01:00:00Z", "total_price": 1}, {"queried_at": "2026-10-08T05:00:00Z", "total_price": 2}, {"queried_at": "2026-10-09T01:00:00Z"})
    assert history.append_observations(d, path) == 2
    assert history.append_observations(d, path) == 0
    assert history.append_observations(make({"hotel_id": "h9"}), path) == 1
    back = history.read_history(spark, path)
    assert back.count() == 3 and int(back.where("hotel_id = 'h1' and to_date(queried_at) = '2026-10-08'").first().total_price) == 1
    assert sorted(p.name for p in (tmp_path / "h" / "month=2026-10").iterdir()) == ["day=2026-10-08", "day=2026-10-09"]
    again = src.read_observations(spark, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, back.collect()))


def test_mirror_is_verified_and_published(spark, make, tmp_path):
    root = str(tmp_path / "w")
    d = make({"rate_plan_name": "with breakfast", "breakfast_included": None}, {"queried_at": "2026-09-08T01:00:00Z", "nights": 2, "total_twd": 9000})
    mirror.build_mirror(d, root)
    back = mirror.read_mirror(spark, root)
    assert back.count() == 2 and {str(r.month) for r in back.collect()} == {"2026-09", "2026-10"}
    assert back.where("observation_id = 'o0'").first().breakfast_included is True
    assert back.where("observation_id = 'o1'").first().nightly_adr_twd == 4500.0
    assert mirror.current_version(spark, root).rows == 2 and mirror.current_version(spark, root).bytes > 0
    mirror.build_mirror(d.where("observation_id = 'o0'"), root)
    assert {str(r.month) for r in mirror.read_mirror(spark, root).collect()} == {"2026-10"}
    with pytest.raises(ValueError, match="verification failed"):
        mirror.verify(d, mirror.read_mirror(spark, root))


def test_daily_migration_verifies_and_refuses(spark, make, tmp_path):
    d = make({}, {}, {"queried_at": "2026-09-01T00:00:00Z"})
    path = str(tmp_path / "daily")
    assert history.to_daily_partitions(d, path) == 3
    with pytest.raises(RuntimeError, match="Refusing"):
        history.to_daily_partitions(d, path)
    with pytest.raises(ValueError):
        history.to_daily_partitions(make({"queried_at": None}), str(tmp_path / "x"))
    assert history.multiset_difference(d, d.where("observation_id <> 'o1'")).first().surplus == 1


def test_rewritten_files_are_compressed(spark, make, tmp_path, monkeypatch):
    d = make({}, {}, {"queried_at": "2026-09-01T00:00:00Z", "city": None}, {"queried_at": "2026-10-09T01:00:00Z"})
    daily, root = tmp_path / "daily", tmp_path / "rewritten"
    assert history.to_daily_partitions(d, str(daily)) == 4
    history.rewrite_history(spark, str(daily), str(root), "daily", lambda x: x)
    for folder in (daily, root / "versions"):
        files = list(folder.rglob("part-*"))
        assert files and all(p.name.endswith(".json.gz") for p in files)
    for back in (src.read_observations(spark, str(daily)), history.read_rewritten(spark, str(root))):
        assert history.multiset_difference(d, back).count() == 0 and back.count() == 4
    assert history.to_daily_partitions(d.where("false"), str(tmp_path / "none")) == 0
    # A record that is lost and one that changes are found out.
    whole = history.read_history
    monkeypatch.setattr(history, "read_history", lambda s, path: whole(s, path).limit(3))
    with pytest.raises(RuntimeError, match="differ"):
        history.to_daily_partitions(d, str(tmp_path / "lost"))
    monkeypatch.setattr(history, "read_history", lambda s, path: whole(s, path).withColumn("city", F.coalesce("city", F.lit("x"))))
    with pytest.raises(RuntimeError, match="differ"):
        history.to_daily_partitions(d, str(tmp_path / "changed"))


def test_backfill_gates(make):
    ok = make({"rooms": None, "source_platform": None}, {"hotel_id": "h2"})
    filled = history.assert_backfill(ok).orderBy("observation_id").first()
    assert (filled.rooms, filled.source_platform) == (1, "official")
    with pytest.raises(ValueError):
        history.assert_backfill(make({"currency": None}))
    with pytest.raises(RuntimeError):
        history.assert_backfill(make({"source_platform": None}, {"source_platform": "official"}))


def test_split_run(make):
    d = make({"run_id": "probe"}, {"run_id": "other"}, {"run_id": None})
    mine, rest = history.split_run(d, "probe")
    assert (mine.count(), rest.count()) == (1, 2)
    with pytest.raises(ValueError):
        history.split_run(d, "absent")


@pytest.mark.parametrize("bound", [400, 1000, 10**9, 1])
def test_shards_are_bounded_and_lossless(spark, make, bound):
    stamp = datetime(2026, 10, 8)
    rows = [{"queried_at": (stamp + timedelta(minutes=i)).strftime("%Y-%m-%dT%H:%M:%SZ"), "room_type_name": "房價" * (1 + i % 7), "hotel_id": "h1" if i % 3 else "h2"} for i in range(60)]
    d = make(*rows).select("observation_id", "hotel_id", "queried_at", "room_type_name")
    s = publish.bounded_shards(d, bound)
    index = publish.shard_index(s).collect()
    assert sum(r.observations for r in index) == 60
    assert all(r.bytes <= bound or r.observations == 1 for r in index)
    got = s.orderBy("hotel_id", "shard", F.col("queried_at").desc()).select("hotel_id", "observation_id").collect()
    want = d.orderBy("hotel_id", F.col("queried_at").desc()).select("hotel_id", "observation_id").collect()
    assert got == want
    if bound == 10**9:
        assert {r.shard for r in index} == {1}


def test_greedy_packing_in_one_task(spark, make):
    d = make(*[{"queried_at": f"2026-10-08T00:{i:02d}:00Z"} for i in range(10)]).select("observation_id", "hotel_id", "queried_at")
    size = publish._sized(d).first()["bytes"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = publish.shard_index(publish.bounded_shards(d, size * 4)).orderBy("shard").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.observations for r in index] == [4, 4, 2]


def test_unsafe_id_aborts(make, tmp_path):
    with pytest.raises(Exception, match="Unsafe hotel id"):
        publish.write_details(make({"hotel_id": "../x"}), str(tmp_path / "d"))


def test_csv_is_spreadsheet_safe(spark, make, tmp_path):
    d = make({"hotel_name": '=HYPERLINK("x")', "room_type_name": None, "breakfast_included": True}).select("hotel_name", "room_type_name", "breakfast_included", "adults")
    publish.write_csv(d, str(tmp_path / "c"))
    parts = [p.read_bytes().decode() for p in (tmp_path / "c").glob("part-*")]
    assert len(parts) == 1, parts
    assert parts[0] == '"hotel_name","room_type_name","breakfast_included","adults"\r\n"\'=HYPERLINK(""x"")","","true","2"\r\n'


def test_asset_manifest_normalises_line_ends(spark, tmp_path):
    for name, body in {"a.json": b"{\r\n}", "b/c.json": b"{\n}", "asset_manifest.json": b"{}"}.items():
        p = tmp_path / "data" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    rows = {r.asset: (r.sha256, r.bytes) for r in publish.asset_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"data/a.json", "data/b/c.json"} and rows["data/a.json"] == rows["data/b/c.json"] and rows["data/a.json"][1] == 3


def test_export_columns(make):
    d = make({}, price=True)
    assert len(publish.export_view(d, "latest").columns) == 38 and len(publish.export_view(d, "history").columns) == 46
    assert publish.export_view(d, "latest", "USD", {"USD": 0.03}).first().display_total == pytest.approx(300.0)
    assert publish.export_view(d, "latest", "EUR", {}).first().display_total == 10000.0


SNAP = {"source_platform": "booking_com", "source_method": "visible_browser_snapshot", "source_property_id": "p", "source_url": "https://x.test"}


def test_snapshot_validation(make):
    d = with_terms(make({**SNAP, "tax_inclusion": "unknown"}, {**SNAP, "source_platform": "official"}, {**SNAP, "source_method": "api"}, {**SNAP, "rate_plan_code": ""}, {**SNAP, "room_size_sqm": None}))
    good, bad = validate_snapshots(d)
    assert [r.observation_id for r in good.collect()] == ["o0"]
    assert [r.reasons for r in bad.orderBy("observation_id").collect()] == [["official_source"], ["unsupported_method"], ["missing_rate_plan_code"], ["unknown_size_band"]]
    with pytest.raises(Exception, match="official_source|unsupported_method|missing_rate_plan_code|unknown_size_band"):
        validate_snapshots(d, strict=True)[0].collect()


def test_payload_shapes(spark):
    payload = {
        "data": {
            "currency": "TWD", "rooms": [{"id": 7, "name": {"en-gb": "Suite"}, "size": {"value": 500, "unit": "sqft"}}],
            "products": [
                {"id": "a", "room": 7, "price": {"total": 100.5, "base": {"booker_currency": 90}}, "policies": {"cancellation": {"type": "non_refundable"}, "meal_plan": {"plan": "breakfast_included"}}},
                {"id": "b", "room": {"id": "9"}, "price": {"total": {"accommodation_currency": 7}}},
                {"id": "c", "price": {}},
            ],
        }
    }
    d = spark.createDataFrame([(json.dumps(payload), "h", "H", "Taipei", None, "TWD", "p1", 2)], "payload string, hotel_id string, hotel_name string, city string, district string, currency string, source_property_id string, adults int").withColumns(
        {"check_in": F.lit("2026-10-01").cast("date"), "check_out": F.lit("2026-10-03").cast("date"), "queried_at": F.lit("2026-09-01 00:00:00").cast("timestamp")}
    )
    a, b = availability_observations(d).orderBy("rate_plan_code").collect()
    assert (a.room_type_name, float(a.room_size_sqm), a.breakfast_included, a.cancellation_policy, float(a.price_before_tax), a.nights, a.lead_days) == ("Suite", 46.45, True, "non refundable", 90.0, 2, 30)
    assert a.rate_plan_name == "Booking.com · breakfast included · non refundable"
    assert (b.room_type_name, float(b.total_price), b.breakfast_included, b.rate_plan_name) == ("Room 9", 7.0, None, "Booking.com")


def test_streamed_ingest_equals_batch(spark, make, tmp_path):
    inbox = tmp_path / "in"
    write_shards(inbox, {"a.jsonl": [line(1), line(2)], "b.jsonl": [line(3, hotel_id="h2")]})
    path, state = str(tmp_path / "h"), str(tmp_path / "s")
    start_ingest(src.stream_observations(spark, str(inbox), files_per_trigger=1), path, state).awaitTermination()
    assert history.read_history(spark, path).count() == 2
    # A late row of an old day still arrives, a repeated one does not.
    write_shards(inbox, {"c.jsonl": [line(4, queried_at="2026-01-01T00:00:00Z"), line(5)]})
    start_ingest(src.stream_observations(spark, str(inbox)), path, state).awaitTermination()
    assert history.read_history(spark, path).count() == 3


def test_streamed_rollup_recomputes_touched_days(spark, make, tmp_path):
    from ratelens.functions.pricing import priced

    inbox = tmp_path / "in"
    write_shards(inbox, {"a.jsonl": [line(1), line(2, total_price="11000", room_type_code="x")]})
    path = str(tmp_path / "h")
    start_ingest(src.stream_observations(spark, str(inbox)), path, str(tmp_path / "s1")).awaitTermination()
    out = str(tmp_path / "roll")
    start_rollups(src.stream_observations(spark, str(inbox)), lambda s: priced(history.read_history(s, path)), out, str(tmp_path / "s2")).awaitTermination()
    r = spark.read.parquet(out).first()
    assert (r.observations, r.median_twd) == (2, 10000.0)


def test_health_stream_equals_batch_over_micro_batches(spark, tmp_path):
    schema = "adapter string, hotel_id string, ts timestamp, seq long, outcome string, status_code int, duration_ms double, reason string"
    t0 = datetime(2026, 9, 24)
    kinds = ["failure", "failure", "success", "failure", "empty", "failure", "failure", "failure"]
    rows = [("web", f"h{i % 2}", t0 + timedelta(minutes=i), i, kinds[(i * 5) % 8], 403 if i % 7 == 0 else None, float(i), "r") for i in range(40)]
    for n, part in enumerate((rows[:15], rows[15:30], rows[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def keep(batch, epoch):
        got.extend(batch.collect())

    for n in range(3):
        spark.read.schema(schema).parquet(str(tmp_path / "in" / f"{n}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        health_stream(s).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {r.hotel_id: r for r in got}
    batch = {r.hotel_id: r for r in health.health_state(spark.createDataFrame(rows, schema)).collect()}
    for h, b in batch.items():
        for c in ("attempts", "successes", "failures", "empty_responses", "blocked_count", "consecutive_failures", "last_status", "last_attempt_at", "last_success_at", "cooldown_until"):
            assert last[h][c] == b[c], (h, c)


def test_shared_folder_is_the_sessions_own(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_stream_fails_on_a_malformed_line_and_skips_other_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "junk.txt").write_text("not a shard")
    (tmp_path / "in" / "a.jsonl").write_text('{"observation_id": "o1"}\n')

    def drain(name):
        q = src.stream_observations(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r.observation_id for r in spark.table(name).collect()]

    assert drain("good_lines") == ["o1"]
    (tmp_path / "in" / "b.jsonl").write_text("NOT JSON\n")
    with pytest.raises(Exception, match="Invalid JSON"):
        drain("bad_lines")


def test_intermediates_of_two_calls_do_not_meet(spark):
    from ratelens.session import cut_lineage, release

    one, two = cut_lineage(spark.range(3), "same-name"), cut_lineage(spark.range(5), "same-name")
    assert (one.count(), two.count()) == (3, 5)
    assert callable(release)


def greedy(sizes, limit):
    out, used, shard = [], 0, 0
    for n in sizes:
        if not out or used + n > limit:
            shard, used = shard + 1, 0
        used += n
        out.append(shard)
    return out


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_shards_do_not_depend_on_partitions(spark, partitions):
    """Many blocks a group, rows above the limit and above a block, one tiny group."""
    rng = random.Random(4)
    sizes = {"a": [rng.choice([3, 40, 99, 100, 101]) for _ in range(120)], "b": [5, 7000, 1, 1, 100, 250, 3, 900, 50], "c": [1000], "d": [60] * 9}
    rows = [(g, i, n) for g, some in sizes.items() for i, n in enumerate(some)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, i int, bytes int").repartition(partitions)
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {span: {(r.g, r.i): r.shard for r in packing.with_shards(d, ["g"], [F.col("i")], 100, span).collect()} for span in ([2, 64] if partitions < 200 else [2])}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(g, i): s for g, some in sizes.items() for i, s in enumerate(greedy(some, 100))}
    assert all(x == want for x in got.values())


def test_rows_out_of_shards(make):
    d = make({"queried_at": None}, {"hotel_id": None}, {}).select("observation_id", "hotel_id", "queried_at")
    assert [r.observation_id for r in publish.bounded_shards(d).collect()] == ["o2"]


def _month_files(path, month):
    return sorted(path.glob(f"month={month}/**/part-*.json"))


def test_mirror_update_reads_changed_months_only(spark, make, tmp_path):
    source, root = tmp_path / "history", str(tmp_path / "w")
    stamp = {"o0": "2026-09-08", "o1": "2026-10-08", "o2": "2026-11-08"}
    d = make(*({"queried_at": f"{day}T01:00:00Z", "hotel_id": o} for o, day in stamp.items()))
    history.append_observations(d, str(source))
    assert mirror.update_mirror(spark, str(source), root) == dict.fromkeys(["2026-09", "2026-10", "2026-11"], "rebuild")
    first = {r.month: r.version for r in mirror.current_manifest(spark, root).collect()}
    kept = _month_files(source, "2026-09")[0]
    stat, size = kept.stat(), len(kept.read_bytes())
    kept.write_bytes(b"x" * size)  # unreadable, but to size and time the same file
    os.utime(kept, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    history.append_observations(make({"queried_at": "2026-10-09T01:00:00Z", "hotel_id": "new"}), str(source))
    shutil.rmtree(source / "month=2026-11")
    assert mirror.update_mirror(spark, str(source), root) == {"2026-09": "keep", "2026-10": "rebuild", "2026-11": "drop"}
    now = {r.month: (r.version == first[r.month], r.rows) for r in mirror.current_manifest(spark, root).collect()}
    assert now == {"2026-09": (True, 1), "2026-10": (False, 2)}
    assert sorted(r.hotel_id for r in mirror.read_mirror(spark, root).collect()) == ["new", "o0", "o1"]
    assert set(mirror.update_mirror(spark, str(source), root).values()) == {"keep"}


def test_a_mirror_update_is_written_in_portions(spark, make, tmp_path, monkeypatch):
    """Each day is a write of its own, a monthly shard is one, and all are one version."""
    source, root = tmp_path / "history", str(tmp_path / "w")
    days = ["2026-09-08", "2026-09-09", "2026-10-01"]
    history.append_observations(make(*({"queried_at": f"{d}T0{h}:00:00Z", "hotel_id": f"{d}{h}"} for d in days for h in (1, 2))), str(source), "gzip")
    assert all(len(list(source.glob(f"month={d[:7]}/day={d}/part-*.json.gz"))) for d in days)
    write_shards(source, {"2026-11.jsonl": [line(1, queried_at="2026-11-03T01:00:00Z"), line(2, queried_at="2026-09-08T05:00:00Z")]})
    written = []
    write = mirror.write_version
    monkeypatch.setattr(mirror, "SOURCE_BYTES", 1)
    monkeypatch.setattr(mirror, "write_version", lambda d, *a, **k: (written.append(d.count()), write(d, *a, **k))[1])
    assert set(mirror.update_mirror(spark, str(source), root).values()) == {"rebuild"}
    assert written == [2, 2, 2, 2]
    now = {r.month: (r.rows, r.natural_keys) for r in mirror.current_manifest(spark, root).collect()}
    assert now == {"2026-09": (5, 5), "2026-10": (2, 2), "2026-11": (1, 1)}
    assert mirror.read_mirror(spark, root).count() == 8 and mirror.current_manifest(spark, root).select("version").distinct().count() == 1
    assert set(mirror.update_mirror(spark, str(source), root).values()) == {"keep"}


def test_a_replay_meets_days_in_order(spark, make, tmp_path, monkeypatch):
    """The newest day is written first, but each day is a micro-batch of its own, in order of
    time, so that no row is late; copies of a key go, and the state holds its digest."""
    days = ["2026-10-09", "2026-09-01", "2026-09-20", None]
    rows = [{"queried_at": f"{d}T0{h}:00:00Z" if d else None, "hotel_id": f"h{i}"} for d in days for i in range(5) for h in (1, 2)]
    table, base, seen = make(*rows), str(tmp_path / "replay"), []

    def start(stream):
        out = ingest.deduplicated_stream(stream)
        assert "DeduplicateWithinWatermark [_digest" in out._jdf.queryExecution().analyzed().toString()

        def write(batch, epoch):
            if batch.count():
                seen.append({r.d for r in batch.select(F.date_format("queried_at", "yyyy-MM-dd").alias("d")).collect()})
                batch.write.mode("append").parquet(f"{base}/out")

        return out.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()

    monkeypatch.setattr(ingest, "REPLAY_BYTES", 1)
    ingest.replay(table, base, start)
    assert seen == [{None}, {"2026-09-01"}, {"2026-09-20"}, {"2026-10-09"}]
    got = spark.read.schema(table.schema).parquet(f"{base}/out")
    assert got.count() == 20 and got.select("hotel_id", F.to_date("queried_at")).distinct().count() == 20


def test_an_unfinished_manifest_counts_for_nothing(spark, make, tmp_path):
    root = str(tmp_path / "w")
    mirror.build_mirror(make({}), root)
    half = tmp_path / "w" / "manifests" / "0000000009-half"
    half.mkdir()
    (half / "part-0.json").write_text("{")
    assert mirror.current_version(spark, root).rows == 1
    mirror.build_mirror(make({}, {"hotel_id": "h2"}), root)
    assert mirror.current_version(spark, root).rows == 2


def test_mirror_of_no_rows(spark, make, tmp_path):
    mirror.build_mirror(make({}).where("hotel_id = 'none'"), str(tmp_path / "w"))
    assert mirror.current_version(spark, str(tmp_path / "w")).rows == 0
    with pytest.raises(ValueError, match="holds no month"):
        mirror.read_mirror(spark, str(tmp_path / "w"))


def test_mirror_finds_lost_rows(spark, make, tmp_path, monkeypatch):
    d = make({}, {"hotel_id": "h2"}, {"hotel_id": "h3", "queried_at": "2026-09-01T00:00:00Z"}, {"queried_at": None})
    monkeypatch.setattr(mirror, "mirror_columns", lambda x: x.where("hotel_id <> 'h2'"))
    with pytest.raises(ValueError, match="month='2026-10', source_rows=2, target_rows=1, missing_keys=1"):
        mirror.build_mirror(d, str(tmp_path / "w"))
    assert mirror.current_manifest(spark, str(tmp_path / "w")) is None


def test_mirror_layout(spark, make, tmp_path):
    rows = [{"hotel_id": f"h{i}", "queried_at": f"2026-10-08T{i % 24:02d}:00:00Z"} for i in range(60)]
    path = mirror.write_version(make(*rows), str(tmp_path / "w"), row_group=10, file_rows=25)
    files = mirror.layout(spark, path).collect()
    assert all(f.codec == "ZSTD" and f.largest_group <= 10 and f.rows <= 25 and f.in_order == f.rows for f in files)
    assert sum(f.rows for f in files) == 60 and len(files) >= 3


def test_merkle_is_of_the_set(spark):
    leaves = [(m, hashlib.sha256(f"{m}{i}".encode()).hexdigest()) for m in "ab" for i in range(40)]

    def up(nodes, n):
        groups = {}
        for node, digest in nodes:
            groups.setdefault(node[:n], []).append(f"{node}:{digest}")
        return [(k, hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest()) for k, v in groups.items()]

    want = {}
    for m in "ab":
        nodes = [(x, x) for y, x in leaves if y == m]
        for n in (4, 2, 0):
            nodes = up(nodes, n)
        want[m] = nodes[0][1]
    d = spark.createDataFrame(leaves, "m string, leaf string")
    for some in (d, d.repartition(7)):
        assert {r.m: r.digest for r in mirror.merkle(some, ["m"], "leaf").collect()} == want


def test_manifest_gate(spark, make, tmp_path):
    root = str(tmp_path / "w")
    mirror.build_mirror(make({}, {"hotel_id": "h2"}, {"queried_at": "2026-09-01T00:00:00Z"}), root)
    rows, m = mirror.read_mirror(spark, root), mirror.current_manifest(spark, root)
    assert quality.assert_manifest(rows, m) == 3
    with pytest.raises(ValueError, match="2026-10: manifest=2, parquet=1"):
        quality.assert_manifest(rows.where("hotel_id <> 'h2'"), m)
    with pytest.raises(ValueError, match="2026-09: manifest=0, parquet=1"):
        quality.assert_manifest(rows, m.where("month <> '2026-09'"))


def test_rewrite_goes_on_where_it_stopped(spark, make, tmp_path):
    source, root = tmp_path / "history", str(tmp_path / "w")
    d = make(*({"queried_at": f"2026-{m}-08T0{i}:00:00Z", "hotel_id": f"h{i % 2}"} for m in ("09", "10", "11") for i in range(4)))
    history.with_day_partitions(d).write.option("ignoreNullFields", "false").partitionBy("month", "day").json(str(source))
    seen = []

    def broken(rows):
        seen.append(len(seen))
        if len(seen) == 2:
            raise RuntimeError("driver lost")
        return history.deduplicate(rows)

    with pytest.raises(RuntimeError, match="driver lost"):
        history.rewrite_history(spark, str(source), root, "latest", broken)
    assert history.read_rewritten(spark, root).count() == 0  # nothing is current yet
    first = _month_files(source, "2026-09")[0]
    stat, size = first.stat(), len(first.read_bytes())
    first.write_bytes(b"x" * size)  # the finished month isn't opened again
    os.utime(first, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    report = history.rewrite_history(spark, str(source), root, "latest", broken)
    assert [(r.month, r.rows_before, r.rows_after) for r in report.orderBy("month").collect()] == [(m, 4, 2) for m in ("2026-09", "2026-10", "2026-11")]
    assert len(seen) == 4
    back = history.read_rewritten(spark, root)
    assert sorted(str(r.queried_at) for r in back.collect()) == sorted(f"2026-{m}-08 0{i}:00:00" for m in ("09", "10", "11") for i in (2, 3))
    with pytest.raises(RuntimeError, match="Refusing"):
        history.deduplicate_history(back, str(source))


def test_sessions_across_hours(spark, make):
    times = ["00:10", "00:40", "00:59", "01:00", "01:31", "02:01", "03:00", "03:00", "05:00"]
    d = make(*({"queried_at": f"2026-10-08T{t}:00Z", "run_id": None, "hotel_id": "h"} for t in times), {"run_id": "r"})
    got = [(str(r.session_start)[11:16], str(r.session_end)[11:16], r.observations) for r in collection_sessions(d).orderBy("session_start").collect()]
    assert got == [("00:10", "01:30", 4), ("01:31", "02:31", 2), ("03:00", "03:30", 2), ("05:00", "05:30", 1)]
    native = d.where("run_id is null").groupBy(F.session_window("queried_at", "30 minutes")).count().orderBy("session_window")
    assert [(str(r.session_window.start)[11:16], str(r.session_window.end)[11:16], r["count"]) for r in native.collect()] == got


def test_median_stream_over_micro_batches(spark, make, tmp_path):
    rng = random.Random(12)
    rows = [{"queried_at": f"2026-10-{8 + i % 2:02d}T0{i % 7}:00:00Z", "hotel_id": f"h{i % 5 // 2}", "total_price": rng.choice([5000, 7000.5, 7000.75, rng.randrange(4000, 90000)])} for i in range(90)]
    d = make(*rows, price=True)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    for part in range(3):
        d.where(F.pmod(F.xxhash64("observation_id"), F.lit(3)) == part).write.mode("append").parquet(str(tmp_path / "in"))
        out = median_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), late="5 days")
        out.writeStream.foreachBatch(lambda b, e: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {(r.hotel_id, str(r.window_start)[:10]): (r.observations, r.median_twd) for r in got}
    prices = {}
    for r in d.collect():
        prices.setdefault((r.hotel_id, str(r.queried_at)[:10]), []).append(float(r.nightly_adr_twd))
    assert last == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in prices.items()}


def test_late_rows_are_merged(spark, make, tmp_path):
    """A newest row, then older versions and newer ones of old days; a replay changes nothing."""
    base = {"hotel_id": "h", "rate_plan_code": "p"}
    parts = [
        [{**base, "queried_at": "2026-10-08T05:00:00Z"}, {**base, "queried_at": "2026-10-01T05:00:00Z"}],
        [{**base, "queried_at": "2026-10-01T09:00:00Z"}, {**base, "queried_at": "2026-10-08T01:00:00Z"}],
        [{**base, "queried_at": "2026-10-01T07:00:00Z"}, {**base, "queried_at": "2026-10-09T00:00:00Z"}],
    ]
    frames = [make(*p) for p in parts]
    for d in frames:
        d.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        start_latest(stream, str(tmp_path / "latest"), str(tmp_path / "cp")).awaitTermination()
    rows = read_latest(spark, str(tmp_path / "latest"), frames[0])
    assert sorted(str(r.queried_at) for r in rows.collect()) == ["2026-10-01 09:00:00", "2026-10-08 05:00:00", "2026-10-09 00:00:00"]
    days = {r.day: (r.rows, r.late_rows, r.epoch) for r in latest_days(spark, str(tmp_path / "latest")).collect()}
    assert days == {"2026-10-01": (1, 2, 2), "2026-10-08": (1, 0, 1), "2026-10-09": (1, 0, 2)}
    ingest._merged(frames[2], str(tmp_path / "latest"), 2, "1 day")
    assert {r.day: r.rows for r in latest_days(spark, str(tmp_path / "latest")).collect()} == {d: n for d, (n, _, _) in days.items()}


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def test_a_written_intermediate_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    written = cut_lineage(df, "sums")
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(key, None) == setting
    assert sorted(df.collect()) == sorted(written.collect()) == sorted(cut_lineage(df, "again").collect())
