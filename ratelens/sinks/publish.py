"""Published detail partitions, size-bounded shards, their index, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratelens.functions.pricing import display_amount
from ratelens.operators.parity import comparison_group_id
from ratelens.sinks.packing import with_shards

# Fixed value: no published shard is larger, unless a single row is.
MAX_SHARD_BYTES = 3_000_000
SAFE_ID = r"^[A-Za-z0-9_-]+$"

# Published columns, in order.
DASHBOARD_COLUMNS = (
    "run_id", "scheduled_for", "hotel_id", "hotel_name", "city", "district", "room_type_code", "room_type_name",
    "room_size_sqm", "check_in", "check_out", "lead_days", "nights", "rooms", "adults", "children",
    "rate_plan_name", "breakfast_included", "cancellation_policy", "price_before_tax",
    "service_charge", "tax", "tax_inclusion", "total_price", "total_twd", "nightly_adr_twd",
    "price_per_sqm", "queried_at", "currency", "source_platform", "source_method", "source_property_id", "source_url",
    "stable_room_type_id", "normalized_room_family", "room_class", "room_match_status", "strict_parity_eligible",
    "size_band", "occupancy", "cancellation_class", "cancellation_deadline", "comparison_key", "comparison_status",
)
HEATMAP_COLUMNS = (
    "hotel_id", "room_type_code", "room_type_name", "room_size_sqm", "check_in", "lead_days",
    "rate_plan_name", "nightly_adr_twd", "price_per_sqm", "queried_at", "source_platform",
)
LATEST_EXPORT = (
    "hotel_name_display", "city", "district", "room_type_code", "room_type_name", "stable_room_type_id", "room_size_sqm",
    "check_in", "check_out", "nights", "lead_days", "rate_plan_name", "breakfast_included", "tax_inclusion",
    "cancellation_policy", "cancellation_class", "cancellation_deadline", "comparison_status", "strict_parity_eligible",
    "comparison_key", "price_before_tax", "service_charge", "tax", "total_price", "currency", "total_twd",
    "nightly_adr_twd", "price_per_sqm", "display_currency", "display_total", "display_nightly_adr",
    "display_price_per_sqm", "queried_at", "run_id", "source_platform", "source_method", "source_property_id", "source_url",
)
HISTORY_EXPORT = (
    "queried_at", "scheduled_for", "run_id", "stay_date", "check_in", "check_out", "city", "district", "hotel_id",
    "hotel_name_display", "room_type_code", "room_name", "room_type_name", "stable_room_type_id", "room_size_sqm", "rooms",
    "adults", "children", "nights", "nightly_adr_twd", "lead_days", "rate_plan", "rate_plan_name", "breakfast",
    "breakfast_included", "tax_inclusion", "cancellation", "cancellation_policy", "cancellation_class",
    "cancellation_deadline", "comparison_status", "strict_parity_eligible", "comparison_key", "price_before_tax",
    "service_charge", "tax", "total_price", "total_twd", "currency", "display_total", "display_price_per_sqm",
    "display_currency", "source_platform", "source_method", "source_property_id", "source_url",
)


def _pick(df: DataFrame, names) -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]


def dashboard_rows(df: DataFrame) -> DataFrame:
    return df.select(*_pick(df, DASHBOARD_COLUMNS))


def heatmap_rows(df: DataFrame) -> DataFrame:
    """Compact rows; the verbose key is reduced to a grouping token."""
    return df.select(*_pick(df, HEATMAP_COLUMNS), comparison_group_id().alias("comparison_group_id"))


def export_view(df: DataFrame, scope: str, currency: str = "TWD", rates: dict[str, float] | None = None) -> DataFrame:
    """The ordered export of the latest batch or of the history, with amounts in the
    display currency as well."""
    rate = F.lit(float((rates or {}).get(currency) or 0.0))
    d = df.withColumns(
        {
            "hotel_name_display": F.coalesce("hotel_name", "hotel_id"),
            "stay_date": F.col("check_in"),
            "room_name": F.col("room_type_name"),
            "rate_plan": F.col("rate_plan_name"),
            "breakfast": F.col("breakfast_included"),
            "cancellation": F.col("cancellation_policy"),
            "display_currency": F.lit(currency),
            "display_total": display_amount("total_twd", rate),
            "display_nightly_adr": display_amount("nightly_adr_twd", rate),
            "display_price_per_sqm": display_amount("price_per_sqm", rate),
        }
    )
    return d.select(*_pick(d, {"latest": LATEST_EXPORT, "history": HISTORY_EXPORT}[scope]))


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run as a formula get an apostrophe; null
    is the empty cell, numbers that are not finite too."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind == "string":
            c = F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, ordered: bool = False) -> None:
    """Rows are rebalanced first, so that no empty partition leaves a file of headers
    only. ``ordered`` says that ``df`` is sorted: then its own partitions, of which the
    sort leaves no empty ones, are written as they are."""
    safe = spreadsheet_safe(df)
    (safe if ordered else safe.hint("rebalance")).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').option(
        "lineSep", "\r\n"
    ).option("nullValue", "").option("emptyValue", "").csv(path)


def checked_ids(df: DataFrame) -> DataFrame:
    """Fail the job on a hotel id that is not safe as a path segment."""
    bad = F.raise_error(F.concat(F.lit("Unsafe hotel id for static partition: "), F.col("hotel_id"))).cast("boolean")
    return df.where(F.when(F.col("hotel_id").rlike(SAFE_ID), F.lit(True)).otherwise(bad))


def partition_index(df: DataFrame) -> DataFrame:
    """Month, hotel, name and observations. Where the rows lie is in ``file_index``."""
    return (
        df.withColumn("month", F.date_format("queried_at", "yyyy-MM"))
        .where("month is not null and hotel_id <> ''")
        .groupBy("month", "hotel_id")
        .agg(F.max_by("hotel_name", F.struct("queried_at", "observation_id")).alias("hotel_name"), F.count("*").alias("observations"))
    )


def write_details(df: DataFrame, path: str) -> None:
    """Month and hotel partitions, newest rows first within a file."""
    d = checked_ids(df).withColumn("month", F.date_format("queried_at", "yyyy-MM")).where("month is not null")
    order = [F.col("month"), F.col("hotel_id"), F.col("queried_at").desc()]
    d.hint("rebalance", "month", "hotel_id").sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "false").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("month", "hotel_id").json(path)


GROUP = ["month", "hotel_id", "day"]
PARTITION_TYPES = {"month": "string", "hotel_id": "string", "day": "string", "shard": "int"}


def file_index(spark: SparkSession, root: str, folder: str, by: list[str]) -> DataFrame:
    """One row for each file written below ``root/folder``, partitioned ``by``: its path
    from ``root`` on, rows and bytes. It lists what is there, so no path is made up, and
    a hotel of any size has as many rows here as files."""
    schema = ", ".join(["value string", *(f"{c} {PARTITION_TYPES[c]}" for c in by)])
    lines = spark.read.schema(schema).text(f"{root}/{folder}")
    at = F.substring_index("_metadata.file_path", f"/{folder}/", -1)
    return (
        lines.select(*by, F.concat(F.lit(f"{folder}/"), at).alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy(*by, "path", "bytes")
        .agg(F.count("*").alias("observations"))
    )


def _sized(df: DataFrame) -> DataFrame:
    d = df.withColumns({"month": F.date_format("queried_at", "yyyy-MM"), "day": F.date_format("queried_at", "yyyy-MM-dd")})
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return d.select(*GROUP, "queried_at", "observation_id", body.alias("body")).withColumn("bytes", F.octet_length("body") + 1)


def bounded_shards(df: DataFrame, max_bytes: int = MAX_SHARD_BYTES, span: int = 64) -> DataFrame:
    """Rows with the number of the shard they go to: newest first, nothing lost, no shard
    above ``max_bytes`` but for a single oversized row. Rows without a time or hotel
    belong to no shard and are left out.

    A (month, hotel, day) that fits is one shard and is never ordered. Larger ones are
    packed greedily in blocks of ``span`` shards (see ``packing``); neither the number of
    tasks nor ``span`` changes the result."""
    rows = _sized(df).where("day is not null and hotel_id is not null")
    totals = rows.groupBy(*GROUP).agg(F.sum("bytes").alias("_total"))
    d = rows.join(totals, GROUP)
    small = d.where(F.col("_total") <= max_bytes).select(*GROUP, "queried_at", "observation_id", "body", "bytes", F.lit(1).alias("shard"))
    big = d.where(F.col("_total") > max_bytes).drop("_total")
    packed = with_shards(big, GROUP, [F.col("queried_at").desc(), F.col("observation_id").desc(), F.col("body")], max_bytes, span)
    return small.unionByName(packed.select(*small.columns))


def shard_index(shards: DataFrame) -> DataFrame:
    """Observations and bytes of every shard."""
    return shards.groupBy(*GROUP, "shard").agg(F.count("*").alias("observations"), F.sum("bytes").alias("bytes"))


def write_shards(shards: DataFrame, path: str) -> None:
    order = [*GROUP, "shard", F.col("queried_at").desc(), F.col("observation_id").desc()]
    # A shard is bounded, so one task can always hold it.
    shards.repartition(*GROUP, "shard").sortWithinPartitions(*order).select(*GROUP, "shard", F.col("body").alias("value")).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "static").partitionBy(*GROUP, "shard").text(path)


# Files that never list themselves.
MANIFEST_EXCLUDED = ("asset_manifest.json", "site_meta.json")


def digest_files(files: DataFrame) -> DataFrame:
    """Path, short digest and size of files read as ``binaryFile``, with CRLF line
    ends read as LF so that a checkout's platform does not matter."""
    # ISO-8859-1 maps bytes to characters one to one, so any content survives.
    text = F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    clean = F.encode(text, "ISO-8859-1")
    return files.select("path", F.substring(F.sha2(clean, 256), 1, 16).alias("sha256"), F.octet_length(clean).alias("bytes"))


def asset_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of every published JSON file but the manifests themselves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{root}/data")
    named = digest_files(files.where(~F.element_at(F.split("path", "/"), -1).isin(*MANIFEST_EXCLUDED)))
    return named.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("asset"), "sha256", "bytes")
