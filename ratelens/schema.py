"""Fixed schemas and domain constants of the rate-observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MONEY = T.DecimalType(18, 4)

RATE_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("observation_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("scheduled_for", T.TimestampType()),
        T.StructField("queried_at", T.TimestampType()),
        T.StructField("check_in", T.DateType()),
        T.StructField("check_out", T.DateType()),
        T.StructField("lead_days", T.IntegerType()),
        T.StructField("nights", T.IntegerType()),
        T.StructField("rooms", T.IntegerType()),
        T.StructField("adults", T.IntegerType()),
        T.StructField("children", T.IntegerType()),
        T.StructField("hotel_id", T.StringType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("room_type_code", T.StringType()),
        T.StructField("room_type_name", T.StringType()),
        T.StructField("room_size_sqm", MONEY),
        T.StructField("rate_plan_code", T.StringType()),
        T.StructField("rate_plan_name", T.StringType()),
        T.StructField("breakfast_included", T.BooleanType()),
        T.StructField("cancellation_policy", T.StringType()),
        T.StructField("price_before_tax", MONEY),
        T.StructField("service_charge", MONEY),
        T.StructField("tax", MONEY),
        T.StructField("tax_inclusion", T.StringType()),
        T.StructField("total_price", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("source_platform", T.StringType()),
        T.StructField("source_method", T.StringType()),
        T.StructField("source_property_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("fx_rate_to_twd", T.DecimalType(18, 8)),
        T.StructField("cpi_index", MONEY),
        T.StructField("cpi_base_index", MONEY),
        # Written by older producers; read so that legacy rows keep their values.
        T.StructField("total_twd", MONEY),
        T.StructField("nightly_adr_twd", MONEY),
        T.StructField("price_per_sqm", MONEY),
        T.StructField("cpi_adjusted_twd", MONEY),
        T.StructField("size_band", T.StringType()),
        T.StructField("stable_room_type_id", T.StringType()),
    ]
)

# Defaults that legacy rows rely on.
LEGACY_DEFAULTS = {"source_platform": "official", "rooms": 1, "adults": 2, "children": 0}
DEFAULT_SOURCE = "official"
DEFAULT_METHOD = "public_booking_page"
UNKNOWN = "unknown"

# Domains.
SCRAPE_STATUSES = ("live", "demo", "unavailable")
TAX_STATES = ("included", "excluded", "unknown")

# Size-band labels, in ascending order.
SIZE_BANDS = ("<45㎡", "45–59㎡", "60–79㎡", "80㎡+")

# The plausible nightly range (TWD) that is published.
PLAUSIBLE_NIGHTLY_TWD = (3_000, 2_000_000)


def conform(df: DataFrame, schema: T.StructType = RATE_SCHEMA) -> DataFrame:
    """Project ``df`` onto ``schema``: absent columns become typed nulls and every
    cast is a ``try_cast``, so that a malformed value is unknown rather than fatal.
    Columns that the schema does not know are kept at the end."""
    present = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in schema.fields:
        if f.name not in present:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif present[f.name] == f.dataType:
            out.append(F.col(f.name))
        else:
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    known = {f.name for f in schema.fields}
    return df.select(*out, *[F.col(c) for c in df.columns if c not in known])
