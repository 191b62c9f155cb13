"""The validated snapshot feed: complete offers seen on other sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.schema import UNKNOWN

SNAPSHOT_METHOD = "visible_browser_snapshot"

# Fields that an offer must carry; an unknown tax is allowed.
REQUIRED = (
    "hotel_id", "check_in", "check_out", "room_type_code", "room_type_name", "rate_plan_code", "rate_plan_name",
    "breakfast_included", "cancellation_policy", "total_price", "source_property_id", "source_url",
)


def _absent(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") == "", F.lit(True))


def with_reject_reasons(termed: DataFrame) -> DataFrame:
    """Add ``reasons``: empty for an acceptable row. Terms are already normalised."""
    rules = {
        "official_source": F.coalesce(F.col("source_platform"), F.lit("official")) == "official",
        "unsupported_method": F.coalesce(F.col("source_method") != SNAPSHOT_METHOD, F.lit(True)),
        **{f"missing_{c}": _absent(c) for c in REQUIRED},
        "unknown_occupancy": F.col("occupancy") == UNKNOWN,
        "unknown_size_band": F.col("size_band") == UNKNOWN,
        "unknown_cancellation_class": F.col("cancellation_class") == UNKNOWN,
    }
    flags = [F.when(cond, F.lit(name)) for name, cond in rules.items()]
    return termed.withColumn("reasons", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def validate_snapshots(termed: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). In strict mode meeting a rejected row fails the job."""
    d = with_reject_reasons(termed)
    ok = F.size("reasons") == 0
    if strict:
        message = F.concat(F.lit("snapshot "), F.coalesce("observation_id", F.lit("?")), F.lit(": "), F.array_join("reasons", ", "))
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return d.where(ok).drop("reasons"), d.where(F.size("reasons") > 0)
