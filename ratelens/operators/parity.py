"""Like-for-like comparison keys and cross-source price gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.cancellation import with_policy_terms
from ratelens.functions.pricing import occupancy_key, size_band, source_of
from ratelens.functions.tax import tax_inclusion
from ratelens.operators.stats import grouped_medians
from ratelens.schema import UNKNOWN
from ratelens.session import cut_lineage

# The order in which missing parts are reported.
MISSING_FIELD_ORDER = (
    "hotel_id", "check_in", "check_out", "occupancy", "room_size", "stable_room_type_id",
    "breakfast_included", "cancellation_class", "cancellation_deadline", "tax_inclusion",
)


def with_terms(df: DataFrame) -> DataFrame:
    """Normalise occupancy, size band, cancellation terms and tax once."""
    return with_policy_terms(df).withColumns(
        {"occupancy": occupancy_key(), "size_band": size_band(), "tax_inclusion": tax_inclusion()}
    )


def _blank(c: str) -> Column:
    text = F.col(c).cast("string")
    return text.isNull() | (text == "")


def missing_parts(require_stable_room: bool = False) -> dict[str, Column]:
    parts = {
        "hotel_id": _blank("hotel_id"),
        "check_in": _blank("check_in"),
        "check_out": _blank("check_out"),
        "occupancy": F.col("occupancy") == UNKNOWN,
        "room_size": F.col("size_band") == UNKNOWN,
        "breakfast_included": F.col("breakfast_included").isNull(),
        "cancellation_class": F.col("cancellation_class") == UNKNOWN,
        "cancellation_deadline": F.col("cancellation_deadline") == UNKNOWN,
        "tax_inclusion": F.col("tax_inclusion") == UNKNOWN,
    }
    if require_stable_room:
        parts["stable_room_type_id"] = _blank("stable_room_type_id")
    return {name: parts[name] for name in MISSING_FIELD_ORDER if name in parts}


def missing_fields(require_stable_room: bool = False) -> Column:
    """Array of the parts that keep a row from forming a key, in fixed order."""
    flags = [F.when(cond, F.lit(name)) for name, cond in missing_parts(require_stable_room).items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def comparison_key(require_stable_room: bool = False) -> Column:
    """The serialised canonical key, null when any part is missing. A stable room
    replaces the size band in the text, yet the band must be known too."""
    ok = F.lit(True)
    for cond in missing_parts(require_stable_room).values():
        ok = ok & ~cond
    return F.when(ok, key_text())


def key_text() -> Column:
    """The serialised form of complete key parts."""
    room = F.when(~_blank("stable_room_type_id"), F.col("stable_room_type_id")).otherwise(F.col("size_band"))
    return F.concat_ws(
        "|",
        "hotel_id",
        F.col("check_in").cast("string"),
        F.col("check_out").cast("string"),
        "occupancy",
        room,
        F.when(F.col("breakfast_included"), F.lit("breakfast")).otherwise(F.lit("room_only")),
        "cancellation_class",
        "cancellation_deadline",
        "tax_inclusion",
    )


def with_comparison(termed: DataFrame, require_stable_room: bool = False) -> DataFrame:
    """Add ``comparison_key``, ``comparison_status``, ``missing_fields`` and
    ``strict_parity_eligible`` to rows whose terms are normalised."""
    out = termed.withColumns(
        {
            "comparison_key": comparison_key(require_stable_room),
            "missing_fields": missing_fields(require_stable_room),
        }
    )
    known = F.col("comparison_key").isNotNull()
    return out.withColumns(
        {
            "comparison_status": F.when(known, F.lit("comparable")).otherwise(F.lit("insufficient_product_metadata")),
            "strict_parity_eligible": known,
        }
    )


def comparison_group_id(key="comparison_key") -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.when(k.isNotNull() & (k != ""), F.substring(F.sha2(k, 256), 1, 16))


KEY_PARTS = (
    "hotel_id", "check_in", "check_out", "occupancy", "size_band", "stable_room_type_id",
    "breakfast_included", "cancellation_class", "cancellation_deadline", "tax_inclusion",
)


def newest_valid_pairs(instants: DataFrame, gap_seconds: int) -> DataFrame:
    """Per (key, other source): the newest instant that has an official instant
    within the gap, and the nearest such official instant.

    ``instants`` is distinct (comparison_key, source, ts). Time is cut into bins as
    wide as the gap, so an official match lies in the same bin or in a neighbour,
    and only each bin's first and last official instant can be the nearest outside
    it. Everything is therefore an aggregate or an equi-join on (key, bin): no
    pairs are enumerated and no key is gathered in one task."""
    gap = gap_seconds * 1_000_000
    t = instants.withColumn("us", F.unix_micros("ts")).withColumn("bin", F.floor(F.col("us") / gap))
    official = t.where("source = 'official'")
    other = t.where("source <> 'official'")
    edges = official.groupBy("comparison_key", "bin").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    # Seen from bin b: the official span of b itself, the last instant of b-1, the
    # first of b+1.
    around = (
        edges.select("comparison_key", "first", "last", F.col("bin").alias("own"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
        .groupBy("comparison_key", "bin")
        .agg(
            F.max(F.when(F.col("own") == F.col("bin"), F.lit(True))).alias("same"),
            F.max(F.when(F.col("own") == F.col("bin") - 1, F.col("last"))).alias("before"),
            F.min(F.when(F.col("own") == F.col("bin") + 1, F.col("first"))).alias("after"),
        )
    )
    near = F.coalesce(F.col("same"), F.lit(False)) | F.coalesce(F.col("us") - F.col("before") <= gap, F.lit(False)) | F.coalesce(F.col("after") - F.col("us") <= gap, F.lit(False))
    newest = (
        other.join(around, ["comparison_key", "bin"])
        .where(near)
        .groupBy("comparison_key", "source")
        .agg(F.max("us").alias("other_us"))
    )
    probe = newest.withColumn("mid", F.floor(F.col("other_us") / gap)).select(
        "comparison_key", F.col("source").alias("other_source"), "other_us",
        F.explode(F.array(F.col("mid") - 1, F.col("mid"), F.col("mid") + 1)).alias("bin"),
    )
    apart = F.abs(F.col("us") - F.col("other_us"))
    nearest = (
        probe.join(official.select("comparison_key", "bin", "us"), ["comparison_key", "bin"])
        .where(apart <= gap)
        .groupBy("comparison_key", "other_source", "other_us")
        .agg(F.min_by("us", F.struct(apart, -F.col("us"))).alias("official_us"))
    )
    return nearest.select(
        "comparison_key",
        "other_source",
        F.timestamp_micros("other_us").alias("other_ts"),
        F.timestamp_micros("official_us").alias("official_ts"),
        (F.abs(F.col("other_us") - F.col("official_us")) / 3.6e9).alias("gap_hours"),
    )


def price_instants(keyed: DataFrame) -> DataFrame:
    """Distinct (comparison_key, source, ts) with the number of prices, the lowest and
    the highest, and the key's parts.

    The first grouping has fixed-width aggregates only, so it hashes and combines on
    the map side; products that differ in the size band alone meet in the second."""
    rows = keyed.where(
        F.col("comparison_key").isNotNull() & F.col("nightly_adr_twd").isNotNull() & F.col("queried_at").isNotNull()
    ).select(*KEY_PARTS, source_of().alias("source"), F.col("queried_at").alias("ts"), "nightly_adr_twd")
    fine = rows.groupBy(*KEY_PARTS, "source", "ts").agg(
        F.count("*").alias("n"), F.min("nightly_adr_twd").alias("lo"), F.max("nightly_adr_twd").alias("hi")
    )
    return (
        fine.withColumn("comparison_key", key_text())
        .groupBy("comparison_key", "source", "ts")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(c).alias(c) for c in KEY_PARTS])
    )


def rate_parity(keyed: DataFrame, max_query_gap_hours: float = 24) -> DataFrame:
    """Price gap per comparison key and other source, official as the base.

    One pass over the rows yields the instants, written as a table because five
    readers follow. Up to two prices at an instant, their median is the mean of lowest
    and highest; rows are read again only for chosen instants with more."""
    run = uuid.uuid4().hex
    instants = cut_lineage(price_instants(keyed), f"parity-instants-{run}")
    pairs = newest_valid_pairs(instants.select("comparison_key", "source", "ts"), int(max_query_gap_hours * 3600))
    pairs = cut_lineage(pairs, f"parity-pairs-{run}")
    on = ["comparison_key", "source", "ts"]
    wanted = pairs.select("comparison_key", F.col("other_source").alias("source"), F.col("other_ts").alias("ts")).unionByName(
        pairs.select("comparison_key", F.lit("official").alias("source"), F.col("official_ts").alias("ts"))
    ).distinct()
    chosen = instants.join(wanted, on, "left_semi")
    medians = chosen.where("n <= 2").select(*on, ((F.col("lo") + F.col("hi")) / 2).alias("median_twd"))
    crowded = chosen.where("n > 2").select(*on)
    timed = keyed.where("comparison_key is not null and nightly_adr_twd is not null").select(
        "comparison_key", source_of().alias("source"), F.col("queried_at").alias("ts"), "nightly_adr_twd"
    )
    more = grouped_medians(timed.join(crowded, on, "left_semi"), on, {"median_twd": "nightly_adr_twd"})
    medians = medians.unionByName(more)
    other = medians.join(instants.select(*on, *KEY_PARTS), on).withColumnsRenamed(
        {"source": "other_source", "ts": "other_ts", "median_twd": "ota_median_twd"}
    )
    official = medians.where("source = 'official'").select(
        "comparison_key", F.col("ts").alias("official_ts"), F.col("median_twd").alias("official_median_twd")
    )
    return (
        pairs.join(other, ["comparison_key", "other_source", "other_ts"])
        .join(official, ["comparison_key", "official_ts"])
        .select(
            "comparison_key",
            *KEY_PARTS,
            F.col("other_source").alias("ota_source"),
            "official_median_twd",
            "ota_median_twd",
            F.try_divide(F.col("ota_median_twd") - F.col("official_median_twd"), F.col("official_median_twd")).alias("gap_percent"),
            F.col("official_ts").alias("official_queried_at"),
            F.col("other_ts").alias("ota_queried_at"),
            F.round("gap_hours", 2).alias("query_time_gap_hours"),
        )
    )


def source_comparison(keyed: DataFrame) -> DataFrame:
    """Per comparison group: official median against the lowest other median."""
    rows = keyed.where(F.col("comparison_key").isNotNull()).withColumns(
        {"group_id": comparison_group_id(), "source": source_of()}
    )
    m = grouped_medians(rows, ["group_id", "source"], {"median_twd": "nightly_adr_twd"})
    official = F.max(F.when(F.col("source") == "official", F.col("median_twd")))
    lowest = F.min(F.when(F.col("source") != "official", F.col("median_twd")))
    return (
        m.groupBy("group_id")
        .agg(official.alias("official_median_twd"), lowest.alias("lowest_ota_median_twd"))
        .where("official_median_twd is not null and lowest_ota_median_twd is not null")
        .withColumn("gap", F.try_divide(F.col("lowest_ota_median_twd") - F.col("official_median_twd"), F.col("official_median_twd")))
    )
