"""Collection plan: which hotel and lead time to query in a run, and the report."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, functions as F

# Lead times that supplemental hotels are limited to.
SUPPLEMENTAL_LEADS = (14, 60)


def parse_lead_days(text: str) -> tuple[int, ...]:
    days = tuple(int(x) for x in text.split(",") if x.strip())
    if not days or min(days) < 1:
        raise ValueError("lead days must be positive comma-separated integers")
    return days


def local_date(moment: Column, zone: Column) -> Column:
    """Calendar date at ``moment`` in the hotel's own time zone."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


# What a hotel record that leaves these out means.
HOTEL_DEFAULTS = {"timezone": "Asia/Taipei", "collection_frequency": "daily", "market_scope": "core"}


def _zone_known(zone: Column) -> Column:
    return zone.isin(sorted(zoneinfo.available_timezones()))


def collection_plan(
    hotels: DataFrame, lead_days: tuple[int, ...], started_at: Column, run_id: Column, cooldowns: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests, failures). Disabled hotels are skipped; weekly hotels are due on
    their local Sunday; supplemental hotels take two lead times only; pairs that are
    cooling down and hotels with an unknown time zone become failure rows."""
    h = hotels.where("coalesce(enabled, true)").withColumn("started_at", started_at)
    h = h.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in HOTEL_DEFAULTS.items()})
    bad_zone = h.where(~_zone_known(F.col("timezone")))
    good = h.where(_zone_known(F.col("timezone"))).withColumn("local_date", local_date(F.col("started_at"), F.col("timezone")))
    due = good.where((F.col("collection_frequency") != "weekly") | (F.dayofweek("local_date") == 1))
    if cooldowns is not None:
        c = cooldowns.where("cooldown_until is not null").select("adapter", "hotel_id", "cooldown_until")
        due = due.join(c, ["adapter", "hotel_id"], "left")
    else:
        due = due.withColumn("cooldown_until", F.lit(None).cast("timestamp"))
    cooling = F.coalesce(F.col("cooldown_until") > F.col("started_at"), F.lit(False))
    leads = F.array(*[F.lit(d) for d in lead_days])
    allowed = F.when(
        F.col("market_scope") == "supplemental", F.array_intersect(leads, F.array(*[F.lit(d) for d in SUPPLEMENTAL_LEADS]))
    ).otherwise(leads)
    requests = due.where(~cooling).withColumn("lead_days", F.explode(allowed)).select(
        run_id.alias("run_id"),
        F.col("started_at").alias("scheduled_for"),
        "adapter", "hotel_id", "lead_days",
        F.date_add("local_date", F.col("lead_days")).alias("check_in"),
        F.date_add("local_date", F.col("lead_days") + 1).alias("check_out"),
    )
    failures = bad_zone.select(
        "hotel_id", F.lit("").alias("lead_days"), F.concat(F.lit("Unknown IANA timezone: "), F.col("timezone")).alias("error")
    ).unionByName(
        due.where(cooling).select(
            "hotel_id", F.lit("").alias("lead_days"),
            F.concat(F.lit("Cooldown active until "), F.date_format("cooldown_until", "yyyy-MM-dd'T'HH:mm:ss")).alias("error"),
        )
    )
    return requests, failures


def restamp(observations: DataFrame, hotels: DataFrame, run_id: Column, scheduled_for: Column) -> DataFrame:
    """Stamp collected rows: lead time against the hotel's local query date, the
    run, and the district where the row lacks one."""
    h = hotels.select("hotel_id", F.col("timezone").alias("_tz"), F.col("district").alias("_district"))
    return observations.join(h, "hotel_id", "left").withColumns(
        {
            "lead_days": F.datediff("check_in", local_date(scheduled_for, F.col("_tz"))),
            "run_id": run_id,
            "scheduled_for": scheduled_for,
            "district": F.coalesce(F.when(F.col("district") != "", F.col("district")), F.col("_district")),
        }
    ).drop("_tz", "_district")


def failure_rows(attempts: DataFrame) -> DataFrame:
    """What the job reports: failed and empty requests with their message."""
    return attempts.where("outcome <> 'success'").select(
        "hotel_id", F.col("lead_days").cast("string").alias("lead_days"),
        F.when(F.col("outcome") == "empty", F.lit("No public rates returned")).otherwise(F.col("reason")).alias("error"),
    )


def job_summary(observations: DataFrame, failures: DataFrame, by: str = "hotel_id") -> DataFrame:
    """Written rows and failures per hotel."""
    w = observations.groupBy(by).agg(F.count("*").alias("observations"))
    f = failures.groupBy(by).agg(F.count("*").alias("failures"))
    return w.join(f, by, "full_outer").select(
        by, F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("failures", F.lit(0)).alias("failures")
    )
