"""SRC1-SRC7, SNK1-SNK15, U1-U3: reading, writing and maintaining history.

Queries that write do so under the shared folder, in a new place each time, and
return what the next reader sees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ratelens.operators import quality
from ratelens.operators.dedup import deduplicate
from ratelens.operators.parity import with_comparison
from ratelens.schema import conform
from ratelens.session import shared_folder, shuffles_removed
from ratelens.sinks import history, mirror, publish
from ratelens.sources import observations as src
from ratelens.sources.payloads import availability_observations, quotation_observations
from ratelens.sources.snapshots import validate_snapshots
from registered.batches import _KEYED
from registered.book import day, query, r, ts
from registered.scalars import TERMS
from registered.view import SQL_DEDUP, SQL_PRICED, _written, mirror_rows, observations, published, raw_rates, rates, sql, table


def fresh_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _json_history(spark, sf) -> str:
    """The view as daily JSON shards, written once per application."""
    key = (spark.sparkContext.applicationId, sf + "#json")
    if key not in _written:
        path = fresh_path(spark, "history")
        d = history.with_day_partitions(rates(spark, sf).select(*raw_rates(spark, sf).columns))
        # One folder per month, one text file set per day, named like the shards.
        d.write.option("ignoreNullFields", "false").option("compression", "gzip").partitionBy("month", "day").json(path)
        _written[key] = path
    return _written[key]


@query("SRC1_SRC2_read_history", sql("""
SELECT observation_id, hotel_id, strftime(queried_at, '%Y-%m-%d %H:%M:%S') AS queried_at, round(total_price, 4) AS total_price, room_size_sqm FROM rates"""))
def src1(spark, sf):
    d = src.read_observations(spark, _json_history(spark, sf))
    return d.select("observation_id", "hotel_id", ts("queried_at").alias("queried_at"), r("total_price", 4).alias("total_price"), F.col("room_size_sqm").cast("double").alias("room_size_sqm"))


@query("SRC3_union_month", sql("""
SELECT hotel_id, CAST(count(*) AS BIGINT) AS rows FROM (SELECT hotel_id FROM rates UNION ALL SELECT hotel_id FROM rates WHERE lead_days = 7) GROUP BY 1"""))
def src3(spark, sf):
    d = observations(spark, sf)
    extra = d.where("lead_days = 7").select("observation_id", "hotel_id", "queried_at")
    return src.union_month(d, extra, month="2026-09").groupBy("hotel_id").agg(F.count("*").alias("rows"))


@query("U1_union_with_schema_drift", sql("""
SELECT coalesce(city, 'none') AS city, coalesce(extra, 'none') AS extra, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT city, NULL AS extra FROM rates UNION ALL SELECT NULL, 'x' FROM rates WHERE lead_days = 7) GROUP BY ALL"""))
def u1(spark, sf):
    d = observations(spark, sf)
    other = d.where("lead_days = 7").select("observation_id", "queried_at").withColumn("extra", F.lit("x"))
    out = src.union_sources(d, other, months_of_history=True)
    return out.groupBy(F.coalesce("city", F.lit("none")).alias("city"), F.coalesce("extra", F.lit("none")).alias("extra")).agg(F.count("*").alias("rows"))


@query("SRC4_snapshot_validation", sql("""
SELECT source_platform = 'official' AS official_source, breakfast_included IS NULL AS no_meal, cancellation_policy IS NULL AS no_policy, size_band = 'unknown' AS no_size, lead_days = 7 AS bad_method,
  CAST(count(*) AS BIGINT) AS rejected
FROM terms WHERE source_platform = 'official' OR breakfast_included IS NULL OR cancellation_policy IS NULL OR size_band = 'unknown' OR lead_days = 7 GROUP BY ALL""", SQL_PRICED, TERMS))
def src4(spark, sf):
    d = observations(spark, sf).withColumns(
        {
            "source_method": F.when(F.col("lead_days") == 7, F.lit("api")).otherwise(F.lit("visible_browser_snapshot")),
            "source_property_id": F.lit("p"), "source_url": F.lit("https://e.test"),
        }
    )
    _, bad = validate_snapshots(d)
    why = F.col("reasons")
    return bad.groupBy(
        F.array_contains(why, "official_source").alias("official_source"), F.array_contains(why, "missing_breakfast_included").alias("no_meal"),
        F.array_contains(why, "missing_cancellation_policy").alias("no_policy"), F.array_contains(why, "unknown_size_band").alias("no_size"),
        F.array_contains(why, "unsupported_method").alias("bad_method"),
    ).agg(F.count("*").alias("rejected"))


_PRODUCTS = """
prod AS (
  SELECT l_orderkey, concat('P', l_partkey, '-', l_linenumber, '-', l_suppkey) AS pid, l_partkey % 5 AS pk, l_linenumber AS ln, l_extendedprice AS price, concat('R', l_partkey % 4) AS rid, l_partkey % 4 AS rk FROM lineitem)
"""


@query("SRC5_availability_payloads", "WITH " + _PRODUCTS.strip() + """
SELECT pid AS rate_plan_code, CASE WHEN pk = 4 THEN NULL ELSE rid END AS room_type_code,
  CASE WHEN pk = 4 THEN 'Available room' WHEN rk = 0 THEN 'Name R0' WHEN rk = 1 THEN 'Zimmer R1' WHEN rk = 2 AND pk = 3 THEN 'Own R2' WHEN rk = 2 THEN 'Room R2' ELSE 'Name R3' END AS room_type_name,
  CAST(CASE WHEN pk = 4 THEN NULL WHEN rk = 0 THEN 30.0 WHEN rk = 1 THEN 27.87 END AS DOUBLE) AS room_size_sqm,
  CASE ln % 3 WHEN 0 THEN 'Free cancellation until 2026-09-01' WHEN 1 THEN 'non refundable' END AS cancellation_policy,
  CASE ln % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' ELSE 'unknown' END AS breakfast,
  concat_ws(' · ', 'Booking.com', CASE ln % 4 WHEN 0 THEN 'breakfast included' WHEN 1 THEN 'room only' WHEN 2 THEN 'room only' END,
            CASE ln % 3 WHEN 0 THEN 'Free cancellation until 2026-09-01' WHEN 1 THEN 'non refundable' END) AS rate_plan_name,
  round(price, 2) AS total_price,
  substr(sha256(concat_ws(':', 'booking_com', concat('hotel_', l_orderkey % 31), concat('prop', l_orderkey % 31), '2026-10-01', pid, '2026-09-01T00:00:00Z')), 1, 24) AS observation_id
FROM prod WHERE pk <> 2""")
def src5(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    p = spark.sql("WITH " + _PRODUCTS + " SELECT * FROM prod")
    # Prices come as numbers, as objects, or not at all; rooms as ids, objects or not.
    price = (
        F.when(F.col("pk") == 2, F.lit("{}"))
        .when(F.col("pk") == 1, F.concat(F.lit('{"total":{"accommodation_currency":'), "price", F.lit("}}")))
        .when(F.col("pk") == 0, F.concat(F.lit('{"total":{"booker_currency":'), "price", F.lit(',"accommodation_currency":1}}')))
        .otherwise(F.concat(F.lit('{"total":'), "price", F.lit("}")))
    )
    room = (
        F.when(F.col("pk") == 4, F.lit("null"))
        .when((F.col("pk") == 3) & (F.col("rk") == 2), F.lit('{"id":"R2","name":"Own R2"}'))
        .when(F.col("pk") == 3, F.concat(F.lit('{"id":"'), "rid", F.lit('"}')))
        .otherwise(F.concat(F.lit('"'), "rid", F.lit('"')))
    )
    cancel = F.when(F.col("ln") % 3 == 0, F.lit('{"type":"free_cancellation","free_cancellation_until":"2026-09-01"}')).when(F.col("ln") % 3 == 1, F.lit('{"type":"non_refundable"}')).otherwise(F.lit("{}"))
    meal = F.when(F.col("ln") % 4 == 0, F.lit('{"plan":"Breakfast_buffet"}')).when(F.col("ln") % 4 == 1, F.lit('{"type":"room_only"}')).when(F.col("ln") % 4 == 2, F.lit('{"plan":"no_breakfast"}')).otherwise(F.lit("{}"))
    one = F.concat(F.lit('{"id":"'), "pid", F.lit('","room":'), room, F.lit(',"price":'), price, F.lit(',"policies":{"cancellation":'), cancel, F.lit(',"meal_plan":'), meal, F.lit("}}"))
    rooms = '[{"id":"R0","name":"Name R0","size":{"value":30,"unit":"sqm"}},{"id":"R1","name":{"de":"Zimmer R1","en":"Room one"},"size":{"value":300,"unit":"sq-ft"}},{"id":"R3","name":"Name R3","size":{"value":20}}]'
    rooms = rooms.replace("sq-ft", "sqft")
    # One response per order: at most seven products.
    payload = p.groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list(one)).alias("items"))
    d = payload.select(
        F.concat(F.lit('{"data":{"currency":"TWD","products":['), "items", F.lit(f'],"rooms":{rooms}}}}}')).alias("payload"),
        F.concat(F.lit("hotel_"), F.col("l_orderkey") % 31).alias("hotel_id"), F.lit("H").alias("hotel_name"), F.lit("Taipei").alias("city"), F.lit(None).cast("string").alias("district"),
        F.lit("TWD").alias("currency"), F.concat(F.lit("prop"), F.col("l_orderkey") % 31).alias("source_property_id"), F.lit("2026-10-01").cast("date").alias("check_in"),
        F.lit("2026-10-02").cast("date").alias("check_out"), F.lit(2).alias("adults"), F.lit("2026-09-01 00:00:00").cast("timestamp").alias("queried_at"),
    )
    out = availability_observations(d)
    flag = F.when(F.col("breakfast_included"), F.lit("yes")).when(~F.col("breakfast_included"), F.lit("no")).otherwise(F.lit("unknown"))
    return out.select(
        "rate_plan_code", "room_type_code", "room_type_name", F.col("room_size_sqm").cast("double").alias("room_size_sqm"), "cancellation_policy", flag.alias("breakfast"),
        "rate_plan_name", r("total_price", 2).alias("total_price"), "observation_id",
    )


@query("SRC6_bulk_quotations", """
SELECT CASE WHEN l_partkey % 4 = 0 THEN 'Deluxe' ELSE concat('room ', l_partkey % 4) END AS room_type_name, CAST(CASE WHEN l_partkey % 4 = 0 THEN 42.0 END AS DOUBLE) AS room_size_sqm,
  concat('flex rate ', l_linenumber) AS rate_plan_name, CAST(count(*) AS BIGINT) AS rows, round(sum(l_extendedprice), 2) AS total
FROM lineitem WHERE l_linenumber <> 3 AND l_partkey % 6 <> 5 GROUP BY ALL""")
def src6(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.concat(F.lit("hotel_"), F.col("l_suppkey") % 31).alias("hotel_id"), F.concat(F.lit(" room-"), F.col("l_partkey") % 4).alias("room"),
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("flex-rate-"), "l_linenumber")).otherwise(F.lit("  ")).alias("rate"),
        F.when(F.col("l_partkey") % 6 != 5, F.col("l_extendedprice")).alias("total_price"), F.lit(2).alias("adults"), F.lit("").alias("currency"),
        F.lit("2026-10-01").cast("date").alias("check_in"), F.lit("2026-10-02").cast("date").alias("check_out"), F.lit("2026-09-01 00:00:00").cast("timestamp").alias("queried_at"),
    )
    rooms = d.select("hotel_id").distinct().select("hotel_id", F.lit("room-0").alias("room"), F.lit("Deluxe").alias("room_name"), F.lit(42.0).alias("size_sqm"))
    out = quotation_observations(d, rooms)
    return out.groupBy("room_type_name", F.col("room_size_sqm").cast("double").alias("room_size_sqm"), "rate_plan_name").agg(
        F.count("*").alias("rows"), F.round(F.sum(F.col("total_price").cast("double")), 2).alias("total")
    )


@query("SRC7_legacy_sheet", sql("""
SELECT observation_id, hotel_id, CAST(CASE WHEN lead_days = 7 THEN 2 ELSE 3 END AS INTEGER) AS adults, CASE WHEN lead_days = 14 THEN 'official' ELSE source_platform END AS source_platform,
  coalesce(run_id, 'none') AS run_id, round(total_price, 4) AS total_price FROM rates"""))
def src7(spark, sf):
    d = rates(spark, sf).withColumns(
        {"adults": F.when(F.col("lead_days") != 7, F.lit(3)), "source_platform": F.when(F.col("lead_days") != 14, F.col("source_platform"))}
    ).withColumn("unknown_column", F.lit("x"))
    path = fresh_path(spark, "sheet")
    src.sheet_rows(d).write.option("header", "true").csv(path)
    out = src.read_sheet(spark, path)
    return out.select("observation_id", "hotel_id", "adults", "source_platform", F.coalesce("run_id", F.lit("none")).alias("run_id"), r("total_price", 4).alias("total_price"))


@query("SNK1_append_twice", sql("SELECT strftime(queried_at, '%Y-%m-%d') AS day, CAST(count(DISTINCT natural_key) AS BIGINT) AS rows FROM k GROUP BY 1", _KEYED))
def snk1(spark, sf):
    path = fresh_path(spark, "appended")
    d = rates(spark, sf)
    history.append_observations(d.where("lead_days <= 14"), path)
    history.append_observations(d, path)
    history.append_observations(d, path)
    return src.read_observations(spark, path).groupBy(day("queried_at").alias("day")).agg(F.count("*").alias("rows"))


def _mirror_root(spark, sf) -> str:
    key = (spark.sparkContext.applicationId, sf + "#root")
    if key not in _written:
        root = fresh_path(spark, "warehouse")
        mirror.build_mirror(rates(spark, sf), root)
        _written[key] = root
    return _written[key]


@query("SNK2_mirror_build", sql("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(nightly) AS BIGINT) AS priced, CAST(count(breakfast_included) AS BIGINT) AS meals,
   CAST(count_if(tax_state <> 'unknown') AS BIGINT) AS taxed FROM terms""", SQL_PRICED, TERMS))
def snk2(spark, sf):
    path = mirror.write_version(mirror_rows(spark, sf), fresh_path(spark, "mirror"))
    d = spark.read.parquet(path)
    return d.agg(
        F.count("*").alias("rows"), F.count("nightly_adr_twd").alias("priced"), F.count("breakfast_included").alias("meals"),
        F.count_if(F.col("tax_inclusion") != "unknown").alias("taxed"),
    )


@query("SNK2_mirror_mode_columns", sql("""
SELECT observation_id, round(total_price / (check_out - check_in), 6) AS nightly,
       CASE WHEN lower(rate_plan_name) LIKE '%room only%' THEN 'no' WHEN lower(rate_plan_name) LIKE '%with breakfast%' THEN 'yes' ELSE 'unknown' END AS breakfast
FROM rates"""))
def snk2b(spark, sf):
    d = mirror.read_mirror(spark, _mirror_root(spark, sf))
    flag = F.when(F.col("breakfast_included"), F.lit("yes")).when(~F.col("breakfast_included"), F.lit("no")).otherwise(F.lit("unknown"))
    return d.select("observation_id", r("nightly_adr_twd").alias("nightly"), flag.alias("breakfast"))


@query("SNK2_mirror_layout", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, 'ZSTD' AS codec, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS rows_in_order, CAST(count(*) AS BIGINT) AS rows_in_bounded_groups FROM rates GROUP BY 1"""))
def snk2c(spark, sf):
    """What the files themselves say: codec, rows not before their predecessor, and rows
    in files whose row groups all keep the bound."""
    files = mirror.layout(spark, mirror.current_version(spark, _mirror_root(spark, sf)).paths[0])
    bounded = F.sum(F.when(F.col("largest_group") <= mirror.ROW_GROUP, F.col("rows")).otherwise(0))
    return files.groupBy("month", "codec").agg(F.sum("rows").alias("rows"), F.sum("in_order").alias("rows_in_order"), bounded.alias("rows_in_bounded_groups"))


@query("SNK3_U2_mirror_comparison", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS source_rows, CAST(count(*) - count_if(lead_days = 90) AS BIGINT) AS target_rows,
  CAST(count(DISTINCT natural_key) - count(DISTINCT natural_key) FILTER (lead_days <> 90) AS BIGINT) AS missing_keys, CAST(0 AS BIGINT) AS extra_keys
FROM k GROUP BY 1""", _KEYED))
def snk3(spark, sf):
    d = rates(spark, sf)
    return mirror.compare(d, mirror.read_mirror(spark, _mirror_root(spark, sf)).where("lead_days <> 90"))


# Three months: the time of observation moves on by none, one or two of them.
_MOVED = """
moved AS (SELECT * REPLACE (queried_at + to_months(CAST(lead_days % 3 AS INTEGER)) AS queried_at) FROM rates),
mk AS (
  SELECT *, strftime(queried_at, '%Y-%m') AS month, concat_ws('|', hotel_id, source_platform, CAST(check_in AS VARCHAR), CAST(check_out AS VARCHAR), rooms, adults, children,
         room_type_code, rate_plan_code, currency, strftime(queried_at, '%Y-%m-%d')) AS natural_key
  FROM moved)
"""


def _moved(spark, sf):
    return rates(spark, sf).withColumn("queried_at", F.expr("queried_at + make_ym_interval(0, lead_days % 3)"))


@query("SNK3_differing_months", sql("""
SELECT month, CAST(count(*) AS BIGINT) AS source_rows, CAST(count_if(hotel_id <> 'hotel_3') AS BIGINT) AS target_rows,
  CAST(count(DISTINCT natural_key) FILTER (hotel_id = 'hotel_3') AS BIGINT) AS missing_keys, CAST(count(DISTINCT natural_key) FILTER (hotel_id = 'hotel_4') AS BIGINT) AS extra_keys
FROM mk WHERE month = '2026-10' GROUP BY 1""", _MOVED).replace("count_if(hotel_id <> 'hotel_3')", "count_if(hotel_id <> 'hotel_3') + count_if(hotel_id = 'hotel_4')"))
def snk3b(spark, sf):
    """One month loses a hotel and gains a made-up one; only that month is compared."""
    d = _moved(spark, sf)
    october = F.date_format("queried_at", "yyyy-MM") == "2026-10"
    target = d.where(~october | (F.col("hotel_id") != "hotel_3"))
    made_up = d.where(october & (F.col("hotel_id") == "hotel_4")).withColumn("hotel_id", F.lit("hotel_x"))
    return mirror.comparison(d, target.unionByName(made_up))


@query("SNK4_update_mirror", sql("""
, per AS (SELECT month, count(*) AS n, count(DISTINCT natural_key) AS keys, count_if(lead_days = 1) + count(DISTINCT natural_key) FILTER (lead_days = 7) AS appended FROM mk GROUP BY 1)
SELECT month, CASE month WHEN '2026-09' THEN 'keep' WHEN '2026-10' THEN 'rebuild' ELSE 'drop' END AS action, month = '2026-09' AS same_version,
  CAST(CASE month WHEN '2026-09' THEN n WHEN '2026-10' THEN appended END AS BIGINT) AS rows, CAST(CASE WHEN month <> '2026-11' THEN keys END AS BIGINT) AS natural_keys
FROM per""", _MOVED))
def snk4(spark, sf):
    """September's files stay, October gets new rows, November's files go."""
    source, root = fresh_path(spark, "changing"), fresh_path(spark, "updated")
    d = _moved(spark, sf).select(*raw_rates(spark, sf).columns)
    with shuffles_removed(spark):
        history.with_day_partitions(d.where("lead_days <> 7")).write.option("ignoreNullFields", "false").option("compression", "gzip").partitionBy("month", "day").json(source)
    mirror.update_mirror(spark, source, root)
    before = mirror.current_manifest(spark, root).select("month", F.col("version").alias("first"))
    history.append_observations(d.where("lead_days = 7"), source, "gzip")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/month=2026-11")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    todo = spark.createDataFrame(list(mirror.update_mirror(spark, source, root).items()), "month string, action string")
    now = mirror.current_manifest(spark, root).select("month", "version", "rows", "natural_keys")
    same = F.coalesce(F.col("version") == F.col("first"), F.lit(False)).alias("same_version")
    return todo.join(now, "month", "left").join(before, "month", "left").select("month", "action", same, "rows", "natural_keys")


@query("SNK4_SNK5_manifest", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT natural_key) AS BIGINT) AS natural_keys, CAST(64 AS INTEGER) AS digest_length, true AS has_bytes
FROM k GROUP BY 1""", _KEYED))
def snk5(spark, sf):
    m = mirror.current_manifest(spark, _mirror_root(spark, sf))
    return m.select("month", "rows", "natural_keys", F.length("sha256").alias("digest_length"), (F.col("bytes") > 0).alias("has_bytes"))


@query("SNK5_content_digest", sql("""
, leaves AS (SELECT DISTINCT month, sha256(natural_key) AS leaf FROM mk),
l4 AS (SELECT month, substring(leaf, 1, 4) AS node, sha256(string_agg(concat(leaf, ':', leaf), chr(10) ORDER BY leaf)) AS digest FROM leaves GROUP BY 1, 2),
l2 AS (SELECT month, substring(node, 1, 2) AS up, sha256(string_agg(concat(node, ':', digest), chr(10) ORDER BY node)) AS digest FROM l4 GROUP BY 1, 2)
SELECT month, sha256(string_agg(concat(up, ':', digest), chr(10) ORDER BY up)) AS digest FROM l2 GROUP BY 1""", _MOVED))
def snk5c(spark, sf):
    return mirror.content_digest(_moved(spark, sf))


@query("SNK5_manifest_totals", sql("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT natural_key) AS BIGINT) AS natural_keys, CAST(count(DISTINCT strftime(queried_at, '%Y-%m')) AS BIGINT) AS partitions FROM k", _KEYED))
def snk5b(spark, sf):
    return mirror.manifest_totals(mirror.current_manifest(spark, _mirror_root(spark, sf)))


@query("DQ8_manifest_gate", sql("""
SELECT c AS case_name, strftime(queried_at, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS stated_rows, CAST(count_if(c = 'whole' OR lead_days <> 90) AS BIGINT) AS found_rows,
  count(*) = count_if(c = 'whole' OR lead_days <> 90) AS agrees
FROM rates, (VALUES ('whole'), ('short')) AS cases(c) GROUP BY 1, 2"""))
def dq8(spark, sf):
    """The manifest against the whole mirror, and against one that lost rows."""
    root = _mirror_root(spark, sf)
    rows, m = mirror.read_mirror(spark, root), mirror.current_manifest(spark, root)
    whole = quality.manifest_gate(rows, m).withColumn("case_name", F.lit("whole"))
    return whole.unionByName(quality.manifest_gate(rows.where("lead_days <> 90"), m).withColumn("case_name", F.lit("short")))


@query("SNK6_published_details", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, hotel_id, CAST(count(*) AS BIGINT) AS rows FROM published GROUP BY ALL""", SQL_PRICED, SQL_DEDUP))
def snk6(spark, sf):
    path = fresh_path(spark, "details")
    publish.write_details(publish.dashboard_rows(with_comparison(published(spark, sf))), path)
    d = spark.read.json(path)
    return d.groupBy(F.col("month").cast("string").alias("month"), "hotel_id").agg(F.count("*").alias("rows"))


@query("SNK6_newest_first", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, hotel_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS rows_in_order FROM published GROUP BY ALL""", SQL_PRICED, SQL_DEDUP))
def snk6b(spark, sf):
    """Lines that are not newer than the line before them in their file."""
    path = fresh_path(spark, "ordered-details")
    publish.write_details(publish.dashboard_rows(published(spark, sf)), path)
    lines = spark.read.schema("value string, month string, hotel_id string").text(path)
    lines = lines.select("month", "hotel_id", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.get_json_object("value", "$.queried_at").alias("at"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("line"))
    return lines.withColumn("kept", F.coalesce(F.col("at") <= before, F.lit(True))).groupBy("month", "hotel_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("rows_in_order"))


@query("SNK7_bounded_shards", sql("""
SELECT hotel_id, strftime(day, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS observations, true AS bounded FROM published GROUP BY ALL""", SQL_PRICED, SQL_DEDUP))
def snk7(spark, sf):
    """With a bound small enough that every busy day is split."""
    bound = 20_000
    shards = publish.shard_index(publish.bounded_shards(publish.dashboard_rows(with_comparison(published(spark, sf))).withColumn("observation_id", F.xxhash64("*").cast("string")), bound))
    fits = (F.col("bytes") <= bound) | (F.col("observations") == 1)
    return shards.groupBy("hotel_id", "day").agg(F.sum("observations").alias("observations"), F.bool_and(fits).alias("bounded"))


@query("SNK7_shard_numbers", sql("""
, q AS (
  SELECT hotel_id, day, row_number() OVER (PARTITION BY hotel_id, day ORDER BY queried_at DESC, observation_id DESC) AS rn,
    length(concat('{"hotel_id":"', hotel_id, '","observation_id":"', observation_id, '","queried_at":"', strftime(queried_at, '%Y-%m-%dT%H:%M:%S'), '.000Z","room_type_code":"', room_type_code, '"}')) + 1 AS bytes
  FROM published),
walk AS (
  SELECT hotel_id, day, rn, bytes, bytes AS used, 1 AS shard FROM q WHERE rn = 1
  UNION ALL
  SELECT q.hotel_id, q.day, q.rn, q.bytes, CASE WHEN used + q.bytes > 1000 THEN q.bytes ELSE used + q.bytes END, shard + CASE WHEN used + q.bytes > 1000 THEN 1 ELSE 0 END
  FROM walk JOIN q ON q.hotel_id = walk.hotel_id AND q.day = walk.day AND q.rn = walk.rn + 1)
SELECT hotel_id, strftime(day, '%Y-%m-%d') AS day, CAST(shard AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS observations, CAST(sum(bytes) AS BIGINT) AS bytes
FROM walk GROUP BY ALL""", SQL_PRICED, SQL_DEDUP).replace("WITH ", "WITH RECURSIVE ", 1))
def snk7b(spark, sf):
    """Every shard of every day, with a bound that a busy day exceeds many times over."""
    rows = published(spark, sf).select("hotel_id", "observation_id", "queried_at", "room_type_code")
    shards = publish.shard_index(publish.bounded_shards(rows, 1_000, span=2))
    return shards.select("hotel_id", "day", "shard", "observations", "bytes")


@query("SNK8_partition_index", sql("""
SELECT strftime(queried_at, '%Y-%m') AS month, hotel_id, concat('Hotel ', substr(hotel_id, 7)) AS hotel_name, CAST(count(*) AS BIGINT) AS observations,
   CAST(count(*) AS BIGINT) AS listed FROM published GROUP BY ALL""", SQL_PRICED, SQL_DEDUP))
def snk8(spark, sf):
    """The catalog next to the rows that the listed files hold."""
    root = fresh_path(spark, "indexed")
    rows = with_comparison(published(spark, sf))
    publish.write_details(publish.dashboard_rows(rows), f"{root}/rates")
    files = publish.file_index(spark, root, "rates", ["month", "hotel_id"])
    listed = files.groupBy("month", "hotel_id").agg(F.sum("observations").alias("listed"))
    return publish.partition_index(rows).join(listed, ["month", "hotel_id"], "full")


@query("SNK9_asset_manifest", sql("""
, p AS (SELECT hotel_id, count(*) AS n FROM published GROUP BY 1)
SELECT hotel_id, CAST(length(concat('{"hotel_id":"', hotel_id, '","observations":', n, '}')) + 1 AS INTEGER) AS bytes,
   substr(sha256(concat('{"hotel_id":"', hotel_id, '","observations":', n, '}', chr(10))), 1, 16) AS sha256 FROM p""", SQL_PRICED, SQL_DEDUP))
def snk9(spark, sf):
    """One small JSON file per hotel, written with CRLF line ends."""
    root = fresh_path(spark, "public")
    d = published(spark, sf).groupBy("hotel_id").agg(F.count("*").alias("observations"))
    d.select(F.col("hotel_id").alias("hotel"), F.to_json(F.struct("hotel_id", "observations")).alias("value")).repartition("hotel").write.partitionBy("hotel").option(
        "lineSep", "\r\n"
    ).text(f"{root}/data")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{root}/data")
    return publish.digest_files(files).select(F.regexp_extract("path", "hotel=([^/]+)/", 1).alias("hotel_id"), "bytes", "sha256")


@query("SNK10_spreadsheet_safe", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN '''=1+1' WHEN 1 THEN '''+x' WHEN 2 THEN '''-x' WHEN 3 THEN '''@x' WHEN 4 THEN 'plain = x' END AS cell,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS number FROM lineitem""")
def snk10(spark, sf):
    k = F.col("l_partkey") % 6
    cell = F.when(k == 0, F.lit("=1+1")).when(k == 1, F.lit("+x")).when(k == 2, F.lit("-x")).when(k == 3, F.lit("@x")).when(k == 4, F.lit("plain = x"))
    number = F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cell.alias("cell"), number.alias("number"))
    return publish.spreadsheet_safe(d)


@query("SNK11_export_views", sql("""
SELECT hotel_name AS hotel_name_display, strftime(check_in, '%Y-%m-%d') AS stay_date, round(total_twd * 0.25, 4) AS display_total, 'USD' AS display_currency, CAST(38 AS INTEGER) AS latest_columns, CAST(46 AS INTEGER) AS history_columns
FROM priced""", SQL_PRICED))
def snk11(spark, sf):
    d = with_comparison(observations(spark, sf))
    h, latest = publish.export_view(d, "history", "USD", {"USD": 0.25}), publish.export_view(d, "latest", "USD", {"USD": 0.25})
    return h.select(
        "hotel_name_display", day("stay_date").alias("stay_date"), r("display_total", 4).alias("display_total"), "display_currency",
        F.lit(len(latest.columns)).alias("latest_columns"), F.lit(len(h.columns)).alias("history_columns"),
    )


@query("SNK12_daily_repartition", sql("SELECT strftime(queried_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS rows FROM rates GROUP BY 1"))
def snk12(spark, sf):
    path = fresh_path(spark, "daily")
    history.to_daily_partitions(rates(spark, sf), path)
    return src.read_observations(spark, path).groupBy(day("queried_at").alias("day")).agg(F.count("*").alias("rows"))


def _history_of_months(spark, sf) -> str:
    """The moved view as a JSON history of three months, written once per application."""
    key = (spark.sparkContext.applicationId, sf + "#months")
    if key not in _written:
        path = fresh_path(spark, "months")
        d = history.with_day_partitions(_moved(spark, sf).select(*raw_rates(spark, sf).columns))
        d.write.option("ignoreNullFields", "false").option("compression", "gzip").partitionBy("month", "day").json(path)
        _written[key] = path
    return _written[key]


@query("SNK12_rewrite_by_month", sql("""
SELECT month, strftime(queried_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT observation_id) AS BIGINT) AS observations FROM mk GROUP BY ALL""", _MOVED))
def snk12b(spark, sf):
    root = fresh_path(spark, "rewritten")
    history.rewrite_history(spark, _history_of_months(spark, sf), root, "daily", lambda d: d)
    d = history.read_rewritten(spark, root)
    return d.groupBy(F.date_format("queried_at", "yyyy-MM").alias("month"), day("queried_at").alias("day")).agg(F.count("*").alias("rows"), F.countDistinct("observation_id").alias("observations"))


@query("SNK14_deduplicated_history", sql("""
, best AS (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY queried_at DESC, observation_id DESC, total_price DESC) AS rn FROM mk),
n AS (SELECT month, count(*) AS rows_before, count(DISTINCT natural_key) AS rows_after FROM mk GROUP BY 1)
SELECT best.month, observation_id, CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after FROM best JOIN n USING (month) WHERE rn = 1""", _MOVED))
def snk14b(spark, sf):
    root = fresh_path(spark, "deduplicated")
    report = history.rewrite_history(spark, _history_of_months(spark, sf), root, "latest", deduplicate)
    d = history.read_rewritten(spark, root).select(F.date_format("queried_at", "yyyy-MM").alias("month"), "observation_id")
    return d.join(report.select("month", "rows_before", "rows_after"), "month")


@query("U3_multiset_difference", sql("SELECT CAST(count(*) AS BIGINT) AS digests, CAST(-count(*) AS BIGINT) AS surplus FROM rates WHERE lead_days = 7"))
def u3(spark, sf):
    d = rates(spark, sf)
    diff = history.multiset_difference(d.where("lead_days <> 7"), d)
    return diff.agg(F.sum(-F.col("surplus")).alias("digests"), F.sum("surplus").alias("surplus"))


@query("SNK13_backfill_counts", sql("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(lead_days = 1) AS BIGINT) AS filled_source_platform, CAST(count_if(lead_days = 7) AS BIGINT) AS filled_rooms, CAST(count_if(lead_days = 14) AS BIGINT) AS filled_adults,
  CAST(0 AS BIGINT) AS filled_children, CAST(0 AS BIGINT) AS missing_check_out, CAST(count_if(lead_days = 60) AS BIGINT) AS missing_currency FROM rates"""))
def snk13(spark, sf):
    return history.backfill_counts(_holed(spark, sf))


def _holed(spark, sf):
    lead = F.col("lead_days")
    return rates(spark, sf).withColumns(
        {
            "source_platform": F.when(lead != 1, F.col("source_platform")), "rooms": F.when(lead != 7, F.col("rooms")), "adults": F.when(lead != 14, F.col("adults")),
            "currency": F.when(lead != 60, F.col("currency")),
        }
    )


@query("SNK13_key_collisions", sql("""
, h AS (SELECT *, CASE WHEN lead_days = 1 THEN 'official' ELSE source_platform END AS s2 FROM rates),
c AS (SELECT count(*) AS n FROM h GROUP BY hotel_id, s2, check_in, check_out, room_type_code, rate_plan_code, currency, CAST(queried_at AS DATE) HAVING count(*) > 1)
SELECT CAST(n AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS keys FROM c GROUP BY 1""", SQL_PRICED))
def snk13b(spark, sf):
    d = history.key_collisions(history.backfill_legacy(_holed_known_currency(spark, sf)))
    return d.groupBy("rows").agg(F.count("*").alias("keys"))


def _holed_known_currency(spark, sf):
    lead = F.col("lead_days")
    return rates(spark, sf).withColumns({"source_platform": F.when(lead != 1, F.col("source_platform")), "rooms": F.when(lead != 7, F.col("rooms"))})


@query("SNK15_split_run", sql("""
SELECT coalesce(run_id, '') = 'run-5' AS quarantined, CAST(count(*) AS BIGINT) AS rows FROM rates GROUP BY 1"""))
def snk15(spark, sf):
    mine, rest = history.split_run(observations(spark, sf), "run-5")
    both = mine.withColumn("quarantined", F.lit(True)).unionByName(rest.withColumn("quarantined", F.lit(False)))
    return both.groupBy("quarantined").agg(F.count("*").alias("rows"))
