"""How well observations resolve to evidenced rooms, and what to review next.

Input rows are matched (``room_match_status`` ...) and keyed with the stable room
required (``missing_fields``, ``strict_parity_eligible``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.functions.distinct import null_safe
from ratelens.functions.pricing import source_of

# Statuses that leave a row unresolved.
UNRESOLVED = ("unmatched_label", "area_mismatch", "ambiguous_label", "missing_room_type_name")


def gap_category() -> Column:
    """What stands between a row and strict comparability; null when nothing does."""
    m = F.col("missing_fields")
    room_missing = F.array_contains(m, "stable_room_type_id")
    only = F.size(m) == 1
    conflict = F.col("room_match_status") == "area_mismatch"
    return F.when(
        ~F.col("strict_parity_eligible"),
        F.when(
            room_missing,
            F.when(conflict & only, F.lit("room_area_conflict_only"))
            .when(conflict, F.lit("room_area_conflict_and_metadata"))
            .when(only, F.lit("room_evidence_only"))
            .otherwise(F.lit("room_evidence_and_metadata")),
        ).otherwise(F.lit("metadata_only")),
    )


def with_gap_category(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "gap_category": gap_category(),
            "room_match_status": F.coalesce("room_match_status", F.lit("not_evaluated")),
            "source_platform": source_of(),
        }
    )


def match_overview(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, mapped and strictly comparable rows with rates (null when empty)."""
    agg = [
        F.count("*").alias("observation_count"),
        F.count_if(F.col("stable_room_type_id") != "").alias("mapped_observations"),
        F.count_if("strict_parity_eligible").alias("strict_parity_eligible_observations"),
        F.count_if(F.col("room_match_status").isin(*UNRESOLVED)).alias("unresolved_observations"),
    ]
    out = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    n = F.col("observation_count")
    return out.withColumns(
        {
            "mapped_rate": F.when(n > 0, F.round(F.col("mapped_observations") / n, 4)),
            "strict_parity_eligible_rate": F.when(n > 0, F.round(F.col("strict_parity_eligible_observations") / n, 4)),
        }
    )


def count_maps(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Status, gap-category and missing-field counts as one long table."""
    by = by or []
    gaps = df.where("not strict_parity_eligible")
    parts = (
        df.select(*by, F.lit("status").alias("kind"), F.col("room_match_status").alias("name")),
        gaps.select(*by, F.lit("gap_category").alias("kind"), F.col("gap_category").alias("name")),
        gaps.select(*by, F.lit("missing_field").alias("kind"), F.explode("missing_fields").alias("name")),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy(*by, "kind", "name").agg(F.count("*").alias("rows"))


CANDIDATE = ["hotel_id", "room_match_status", "room_type_name", "room_type_code", "source_platform", "room_size_sqm"]


def unresolved_candidates(df: DataFrame) -> DataFrame:
    """Unresolved labels with counts, newest sighting and what blocks them."""
    g = F.col("gap_category")
    return (
        df.where(F.col("room_match_status").isin(*UNRESOLVED) & (F.col("hotel_id") != ""))
        .groupBy(*CANDIDATE)
        .agg(
            F.count("*").alias("observations"),
            F.max("queried_at").alias("latest_queried_at"),
            F.max_by("source_url", F.struct("queried_at", "observation_id")).alias("sample_source_url"),
            F.count_if(g == "room_evidence_only").alias("unlockable"),
            F.count_if(g == "room_evidence_and_metadata").alias("blocked"),
            F.count_if(g.isin("room_area_conflict_only", "room_area_conflict_and_metadata")).alias("area_conflict"),
        )
    )


def top_candidates(candidates: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent candidates of every hotel."""
    w = Window.partitionBy("hotel_id").orderBy(
        F.col("observations").desc(), "source_platform",
        F.coalesce("room_type_name", F.lit("")), F.coalesce("room_type_code", F.lit("")),
        "room_match_status", F.col("room_size_sqm").asc_nulls_first(),
    )
    return candidates.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


REVIEW_KEY = ["hotel_id", "source_platform", "room_type_code", "room_type_name", "size_text"]


def review_key(df: DataFrame) -> DataFrame:
    """Exact key of a room-mapping review; the size is text without trailing zeros."""
    text = F.col("room_size_sqm").cast("decimal(28,8)").cast("string")
    size = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return df.withColumns(
        {
            "source_platform": source_of(),
            "room_type_code": F.coalesce("room_type_code", F.lit("")),
            "room_type_name": F.coalesce("room_type_name", F.lit("")),
            "size_text": F.coalesce(size, F.lit("")),
        }
    )


def reviewed_candidates(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with their review, if one names exactly this label."""
    r = review_key(reviews).select(
        *REVIEW_KEY, F.col("status").alias("review_status"), "reviewed_at",
        F.col("note").alias("review_note"), F.col("evidence_urls").alias("review_evidence_urls"),
    )
    return null_safe(review_key(candidates), r, REVIEW_KEY)


def stale_room_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    return review_key(reviews).join(review_key(candidates).select(*REVIEW_KEY).distinct(), REVIEW_KEY, "left_anti")


def mapping_priority(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hotels by how many observations new room evidence would unlock, reviewed
    labels left out."""
    open_ = reviewed_candidates(candidates, reviews).where(
        "review_status is null and (unlockable > 0 or blocked > 0)"
    )
    return open_.groupBy("hotel_id").agg(
        F.sum("unlockable").alias("unlockable"), F.sum("blocked").alias("blocked"), F.count("*").alias("candidates")
    )


def strict_gap_hotels(df: DataFrame) -> DataFrame:
    """Hotels with rows that lack some part of the key, worst first in reports."""
    rows = df.where(F.col("hotel_id") != "")
    return (
        rows.groupBy("hotel_id")
        .agg(
            F.max_by("hotel_name", F.struct("queried_at", "observation_id")).alias("hotel_name"),
            F.max_by("city", F.struct("queried_at", "observation_id")).alias("city"),
            F.count("*").alias("observations"),
            F.count_if("strict_parity_eligible").alias("strict_parity_eligible_observations"),
            F.count_if(~F.col("strict_parity_eligible")).alias("strict_parity_gap_observations"),
            F.array_join(F.array_sort(F.collect_set("source_platform")), ",").alias("source_platforms"),
            F.count_if(F.col("gap_category").isin("room_area_conflict_only", "room_area_conflict_and_metadata")).alias("area_conflict"),
        )
        .where("strict_parity_gap_observations > 0")
    )
