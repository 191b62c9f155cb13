"""Evidence coverage of the curated hotel profiles.

Profiles are read with a fixed schema, so a boolean field is a boolean or null and
an inventory is an integer or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.operators.stats import beside
from ratelens.operators.rooms import ROOM

# Facilities and checks, in report order.
FACILITIES = ("pool", "fitness", "spa", "sauna", "steam_room")
CHECKS = (
    "monthly_review_current", "stay_times_sourced", "room_inventory_known", "restaurants_documented",
    "lounge_status_explicit", "room_snapshot_sourced", "source_urls_present", "all_rooms_trilingual",
    "all_rooms_have_area",
)

PROFILE_SCHEMA = (
    "hotel_id string, verified_at string, "
    "stay_times struct<check_in:string,check_out:string,source_type:string,source_url:string>, "
    "room_inventory int, restaurants array<string>, "
    "facilities struct<pool:boolean,fitness:boolean,spa:boolean,sauna:boolean,steam_room:boolean>, "
    "lounge struct<available:boolean>, "
    f"room_snapshot struct<observed_at:string,source_type:string,source_url:string,rooms:array<{ROOM}>>, "
    "source_urls array<string>, "
    "michelin_restaurants array<struct<name:string,guide_year:int,distinction:string,verified_at:string,"
    "source_url:string,restaurant_url:string,relationship:string>>"
)


def _given(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _filled(c: str) -> Column:
    return F.coalesce(F.size(F.col(c)) > 0, F.lit(False))


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10).try_cast("date")


def percent(n: Column, d: Column) -> Column:
    """Two decimals; a share of nothing is 0 here."""
    return F.when(d > 0, F.bround(n / d * 100, 2)).otherwise(F.lit(0.0))


def profile_rows(profiles: DataFrame, updated_at: str | None = None, review_days: int = 31) -> DataFrame:
    """One row per hotel: the nine checks, room counts, missing evidence. Age is
    measured against the newest date in the source, so that rebuilds agree."""
    newest = profiles.agg(
        F.greatest(F.max(_day(F.col("verified_at"))), F.lit(updated_at).cast("string").try_cast("date")).alias("d")
    ).scalar()
    rooms = F.coalesce("room_snapshot.rooms", F.array().cast(f"array<{ROOM}>"))
    three = F.filter("_rooms", lambda r: (r["name_zh"] != "") & (r["name_en"] != "") & (r["name_ja"] != ""))
    sized = F.filter(
        "_rooms", lambda r: r["size_sqm"].isNotNull() | r["size_sqm_min"].isNotNull() | r["size_sqm_max"].isNotNull()
    )
    d = profiles.withColumns({"_rooms": rooms, "as_of": newest}).withColumns(
        {
            "review_age_days": F.datediff("as_of", _day(F.col("verified_at"))),
            "room_count": F.size("_rooms"),
            "trilingual_room_count": F.size(three),
            "area_documented_room_count": F.size(sized),
        }
    )
    some = F.col("room_count") > 0
    checks = {
        "monthly_review_current": F.coalesce(F.col("review_age_days") <= review_days, F.lit(False)),
        "stay_times_sourced": _given("stay_times.check_in") & _given("stay_times.check_out") & _given("stay_times.source_type") & _given("stay_times.source_url"),
        "room_inventory_known": F.coalesce(F.col("room_inventory") > 0, F.lit(False)),
        "restaurants_documented": _filled("restaurants"),
        "lounge_status_explicit": F.col("lounge.available").isNotNull(),
        "room_snapshot_sourced": some & _given("room_snapshot.observed_at") & _given("room_snapshot.source_type") & _given("room_snapshot.source_url"),
        "source_urls_present": _filled("source_urls"),
        "all_rooms_trilingual": some & (F.col("trilingual_room_count") == F.col("room_count")),
        "all_rooms_have_area": some & (F.col("area_documented_room_count") == F.col("room_count")),
    }
    d = d.withColumns(checks).withColumns({f"has_{f}": F.col(f"facilities.{f}").isNotNull() for f in FACILITIES})

    def absent(names, prefix=""):
        return F.filter(F.array(*[F.when(~F.col(prefix + n), F.lit(n)) for n in names]), lambda x: x.isNotNull())

    return d.select(
        "hotel_id", "verified_at", "as_of", "review_age_days", "room_count", "trilingual_room_count",
        "area_documented_room_count", *CHECKS, *[f"has_{f}" for f in FACILITIES],
        F.coalesce("room_snapshot.source_type", F.lit("unknown")).alias("snapshot_source_type"),
        absent(CHECKS).alias("missing_evidence"), absent(FACILITIES, "has_").alias("unknown_facilities"),
    )


def hotel_ranking(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.size("missing_evidence").desc(), F.size("unknown_facilities").desc(), "hotel_id")


def coverage(rows: DataFrame) -> DataFrame:
    """Count, total and percent of every check, facility and room property."""
    n = F.count("*").alias("_n")
    sums = rows.agg(
        n,
        *[F.count_if(c).alias(c) for c in CHECKS],
        *[F.count_if(f"has_{f}").alias(f"has_{f}") for f in FACILITIES],
        F.coalesce(F.sum("room_count"), F.lit(0)).alias("_rooms"),
        F.coalesce(F.sum("trilingual_room_count"), F.lit(0)).alias("_tri"),
        F.coalesce(F.sum("area_documented_room_count"), F.lit(0)).alias("_area"),
    )
    lines = (
        [(F.lit("profile"), F.lit(c), F.col(c), F.col("_n")) for c in CHECKS]
        + [(F.lit("facility"), F.lit(f), F.col(f"has_{f}"), F.col("_n")) for f in FACILITIES]
        + [(F.lit("room"), F.lit("trilingual_names"), F.col("_tri"), F.col("_rooms")), (F.lit("room"), F.lit("area_documented"), F.col("_area"), F.col("_rooms"))]
    )
    items = F.array(
        *[F.struct(a.alias("section"), b.alias("field"), c.cast("long").alias("count"), d.cast("long").alias("total")) for a, b, c, d in lines]
    )
    return sums.select(F.explode(items).alias("x")).select("x.*").withColumn("percent", percent(F.col("count"), F.col("total")))


def snapshot_source_types(rows: DataFrame) -> DataFrame:
    return rows.groupBy("snapshot_source_type").agg(F.count("*").alias("profiles"))


def award_entries(profiles: DataFrame) -> DataFrame:
    """Evidenced restaurant distinctions."""
    e = profiles.select("hotel_id", F.explode("michelin_restaurants").alias("m")).select("hotel_id", "m.*")
    return e.where(
        (F.col("name") != "") & (F.col("guide_year") != 0) & (F.col("distinction") != "")
        & (F.col("source_url") != "") & (F.col("verified_at") != "")
    ).withColumn("relationship", F.coalesce("relationship", F.lit("hotel_restaurant")))


def award_summary(profiles: DataFrame) -> DataFrame:
    return award_entries(profiles).agg(
        F.count("*").alias("restaurant_count"),
        F.countDistinct("hotel_id").alias("hotel_count"),
        F.max("guide_year").alias("latest_guide_year"),
    )


def profile_summary(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    head = rows.agg(
        F.max("as_of").alias("as_of"), F.count("*").alias("profile_count"), F.coalesce(F.sum("room_count"), F.lit(0)).alias("room_count")
    )
    return beside(head, award_summary(profiles))
