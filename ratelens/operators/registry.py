"""Registries of human review decisions and the availability-check log.

A validator returns the rejected rows with their reasons; ``strict`` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

# Allowed dispositions.
METADATA_STATUSES = ("blocked_source_shell", "blocked_source_unavailable", "blocked_no_explicit_label")
ROOM_STATUSES = ("blocked_ambiguous_label", "blocked_area_mismatch")
CHECK_STATUSES = ("no_availability", "blocked", "verification_required")

METADATA_REVIEW_SCHEMA = (
    "hotel_id string, source_platform string, missing_fields array<string>, status string, "
    "reviewed_at string, evidence_urls array<string>, note string"
)
ROOM_REVIEW_SCHEMA = (
    "hotel_id string, source_platform string, room_type_code string, room_type_name string, room_size_sqm double, "
    "status string, reviewed_at string, evidence_urls array<string>, note string"
)
CHECK_LOG_SCHEMA = (
    "hotel_id string, source_platform string, check_in string, check_out string, "
    "occupancy struct<adults:int,children:int,rooms:int>, checked_at timestamp, status string, reason string"
)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def _urls_bad(c: str = "evidence_urls") -> Column:
    ok = (F.size(F.col(c)) > 0) & F.forall(c, lambda u: u.startswith("https://"))
    return ~F.coalesce(ok, F.lit(False))


def _rejects(df: DataFrame, key: list[Column], rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule. A key seen before is one: counting per key and
    joining back keeps a key with very many copies out of a single task."""
    keyed = df.withColumn("_key", F.to_json(F.struct(*key)))
    twice = keyed.groupBy("_key").agg(F.count("*").alias("_copies"))
    d = keyed.join(twice, "_key")
    found = {**rules, "duplicate_key": F.col("_copies") > 1}
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
    return d.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("_key", "_copies")


def _strict(rejects: DataFrame, what: str) -> None:
    first = rejects.select(F.to_json(F.struct("*")).alias("j")).take(1)
    if first:
        raise ValueError(f"Invalid {what}: {first[0].j}")


def metadata_review_rejects(reviews: DataFrame, strict: bool = False) -> DataFrame:
    fields = F.col("missing_fields")
    sane = (F.size(fields) > 0) & F.forall(fields, lambda x: x != "") & (F.size(F.array_distinct(fields)) == F.size(fields))
    out = _rejects(
        reviews,
        [F.col("hotel_id"), F.col("source_platform"), F.array_sort(fields).alias("f")],
        {
            "hotel_id": _blank("hotel_id"),
            "source_platform": _blank("source_platform"),
            "missing_fields": ~F.coalesce(sane, F.lit(False)),
            "status": ~F.coalesce(F.col("status").isin(*METADATA_STATUSES), F.lit(False)),
            "reviewed_at": ~F.coalesce(F.col("reviewed_at").rlike(ISO_DATE), F.lit(False)),
            "evidence_urls": _urls_bad(),
            "note": _blank("note"),
        },
    )
    if strict:
        _strict(out, "strict metadata review entry")
    return out


def room_review_rejects(reviews: DataFrame, strict: bool = False) -> DataFrame:
    out = _rejects(
        reviews,
        [F.col(c) for c in ("hotel_id", "source_platform", "room_type_code", "room_type_name", "room_size_sqm")],
        {
            "status": ~F.coalesce(F.col("status").isin(*ROOM_STATUSES), F.lit(False)),
            "reviewed_at": ~F.coalesce(F.col("reviewed_at").rlike(ISO_DATE), F.lit(False)),
            "evidence_urls": _urls_bad(),
        },
    )
    if strict:
        _strict(out, "room mapping review")
    return out


def check_log_rejects(log: DataFrame, strict: bool = False) -> DataFrame:
    """Status domain, reason present, one entry per (hotel, source, stay)."""
    out = _rejects(
        log,
        [F.col(c) for c in ("hotel_id", "source_platform", "check_in", "check_out")],
        {
            "status": ~F.coalesce(F.col("status").isin(*CHECK_STATUSES), F.lit(False)),
            "reason": _blank("reason"),
        },
    )
    if strict:
        _strict(out, "availability check")
    return out
