"""Warehouse completeness, metadata gaps, reviews and day-to-day warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ratelens.functions.cancellation import cancellation_blocker, cancellation_schedule
from ratelens.functions.distinct import per_distinct
from ratelens.functions.pricing import number, verified_market
from ratelens.operators.dedup import latest_batches
from ratelens.operators.market import observed_day
from ratelens.operators.stats import grouped_stats
from ratelens.schema import UNKNOWN


def ratio(n, d):
    """Six decimals; 0 for an empty denominator."""
    return F.when(d > 0, F.round(n / d, 6)).otherwise(F.lit(0.0))


def _source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_platform", F.coalesce("source_platform", F.lit(UNKNOWN)))


def _known(col: str):
    return F.trim(F.coalesce(F.col(col), F.lit(""))) != ""


def completeness(df: DataFrame) -> DataFrame:
    """Known-value counts for the whole table, per source and per hotel, from one
    pass with grouping sets. ``grain`` names the level of a row."""
    size_known = F.coalesce(number("room_size_sqm") > 0, F.lit(False))
    tax_known = F.coalesce(F.col("tax_inclusion"), F.lit(UNKNOWN)) != UNKNOWN
    flags = _source(df).select(
        "hotel_id", "source_platform", "queried_at",
        size_known.cast("long").alias("k_size"),
        tax_known.cast("long").alias("k_tax"),
        _known("cancellation_policy").cast("long").alias("k_policy"),
        F.col("nightly_adr_twd").isNotNull().cast("long").alias("k_adr"),
    )
    level = F.grouping_id()
    out = flags.groupingSets(
        [[], ["source_platform"], ["hotel_id"]], "source_platform", "hotel_id"
    ).agg(
        level.alias("_g"),
        F.count("*").alias("rows"),
        F.countDistinct("hotel_id").alias("hotels"),
        F.min("queried_at").alias("queried_at_min"),
        F.max("queried_at").alias("queried_at_max"),
        F.sum("k_size").alias("known_room_size_rows"),
        F.sum("k_tax").alias("known_tax_rows"),
        F.sum("k_policy").alias("known_cancellation_policy_rows"),
        F.sum("k_adr").alias("nightly_adr_rows"),
    )
    grain = F.when(F.col("_g") == 3, F.lit("all")).when(F.col("_g") == 1, F.lit("source")).otherwise(F.lit("hotel"))
    return out.withColumn("grain", grain).drop("_g").withColumn(
        "unknown_room_size_rows", F.col("rows") - F.col("known_room_size_rows")
    ).withColumn("unknown_tax_rows", F.col("rows") - F.col("known_tax_rows"))


def with_schedule(df: DataFrame) -> DataFrame:
    return per_distinct(df, ["cancellation_policy"], {"cancellation_schedule": cancellation_schedule()})


def terms_coverage(termed: DataFrame) -> DataFrame:
    """Known class, deadline and schedule per source, with ratios. ``termed`` has
    class and deadline."""
    d = with_schedule(_source(termed))
    out = d.groupBy("source_platform").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("cancellation_class") != UNKNOWN).alias("known_cancellation_class_rows"),
        F.count_if(F.col("cancellation_deadline") != UNKNOWN).alias("known_cancellation_deadline_rows"),
        F.count_if(F.size("cancellation_schedule") > 0).alias("known_cancellation_schedule_rows"),
    )
    n = F.col("rows")
    return out.withColumns(
        {
            f"known_cancellation_{k}_ratio": ratio(F.col(f"known_cancellation_{k}_rows"), n)
            for k in ("class", "deadline", "schedule")
        }
    )


def readiness(keyed: DataFrame) -> DataFrame:
    """Rows with no missing part, per source and overall (source null)."""
    d = _source(keyed).select("source_platform", (F.size("missing_fields") == 0).cast("long").alias("ok"))
    out = d.groupingSets([[], ["source_platform"]], "source_platform").agg(
        F.count("*").alias("rows"), F.sum("ok").alias("strict_metadata_ready_rows")
    )
    return out.withColumn("strict_metadata_ready_ratio", ratio(F.col("strict_metadata_ready_rows"), F.col("rows")))


def missing_field_counts(keyed: DataFrame, by: list[str]) -> DataFrame:
    """One row per (by..., missing field) with the number of rows lacking it."""
    return (
        _source(keyed)
        .select(*by, F.explode("missing_fields").alias("field"))
        .groupBy(*by, "field")
        .agg(F.count("*").alias("rows"))
    )


GAP_KEYS = ["hotel_id", "source_platform"]


def metadata_gaps(keyed: DataFrame, with_time: bool = False) -> DataFrame:
    """Per (hotel, source) with gaps: rows, the missing fields with counts (most
    frequent first), and the sorted signature that reviews refer to."""
    gaps = _source(keyed).where(F.size("missing_fields") > 0)
    total = gaps.groupBy(*GAP_KEYS).agg(
        F.count("*").alias("rows"), *([F.max("queried_at").alias("latest_queried_at")] if with_time else [])
    )
    # At most ten field names per group.
    fields = (
        missing_field_counts(gaps, GAP_KEYS)
        .groupBy(*GAP_KEYS)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("o"), "field", F.col("rows").alias("n")))).alias("f"))
        .select(
            *GAP_KEYS,
            F.transform("f", lambda x: F.concat_ws("=", x["field"], x["n"].cast("string"))).alias("missing_fields"),
            F.array_sort(F.transform("f", lambda x: x["field"])).alias("signature"),
        )
    )
    return total.join(fields, GAP_KEYS)


def latest_metadata_gaps(keyed: DataFrame) -> DataFrame:
    """The same on each stream's newest batch; the 30-minute rule also takes rows
    that carry a run id."""
    return metadata_gaps(latest_batches(_source(keyed), strict_legacy=False), with_time=True)


def unknown_policies(termed: DataFrame) -> DataFrame:
    """Non-empty policies that have no class, with the reason why."""
    d = _source(termed).where((F.col("cancellation_class") == UNKNOWN) & _known("cancellation_policy"))
    counted = d.groupBy(*GAP_KEYS, F.trim("cancellation_policy").alias("cancellation_policy")).agg(F.count("*").alias("rows"))
    return counted.withColumn("reason", cancellation_blocker())


def blocker_counts(termed: DataFrame) -> DataFrame:
    return unknown_policies(termed).groupBy("reason", *GAP_KEYS).agg(F.sum("rows").alias("rows"))


def structured_schedules(termed: DataFrame) -> DataFrame:
    d = with_schedule(_source(termed)).where(F.size("cancellation_schedule") > 0)
    return d.groupBy(
        *GAP_KEYS, F.trim("cancellation_policy").alias("cancellation_policy"), F.to_json("cancellation_schedule").alias("schedule")
    ).agg(F.count("*").alias("rows"))


def ranked(df: DataFrame, *ties: str, limit: int | None = None) -> DataFrame:
    """Most rows first, ties by name; a limit is a report's top-k."""
    out = df.orderBy(F.col("rows").desc(), *ties)
    return out.limit(limit) if limit else out


def review_outcome(gaps: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mark each gap 'reviewed' when a review names exactly its hotel, source and
    set of missing fields, else 'actionable'; the review's fields come along."""
    r = reviews.select(
        *GAP_KEYS, F.array_sort("missing_fields").alias("signature"),
        F.col("status").alias("review_status"), "reviewed_at",
        F.col("evidence_urls").alias("review_evidence_urls"), F.col("note").alias("review_note"),
    )
    return gaps.join(r, [*GAP_KEYS, "signature"], "left").withColumn(
        "disposition", F.when(F.col("review_status").isNull(), F.lit("actionable")).otherwise(F.lit("reviewed"))
    )


def stale_reviews(reviews: DataFrame, *gaps: DataFrame) -> DataFrame:
    """Reviews that no current gap (history or latest) matches any more."""
    seen = None
    for g in gaps:
        part = g.select(*GAP_KEYS, "signature")
        seen = part if seen is None else seen.unionByName(part)
    return reviews.withColumn("signature", F.array_sort("missing_fields")).join(
        seen.distinct(), [*GAP_KEYS, "signature"], "left_anti"
    ).drop("signature")


def reviewed_gaps(history: DataFrame, latest: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed gaps of the history, then those that only the latest batch has."""
    h = review_outcome(history, reviews).where("disposition = 'reviewed'").withColumn("scope", F.lit("history"))
    only = review_outcome(latest, reviews).where("disposition = 'reviewed'").withColumn("scope", F.lit("latest"))
    only = only.join(h.select(*GAP_KEYS, "signature"), [*GAP_KEYS, "signature"], "left_anti")
    return h.unionByName(only, allowMissingColumns=True)


def top_tax_gaps(per_hotel: DataFrame, limit: int = 10) -> DataFrame:
    return (
        per_hotel.where("grain = 'hotel'")
        .select("hotel_id", "rows", "known_tax_rows", "unknown_tax_rows")
        .orderBy(F.col("unknown_tax_rows").desc(), "hotel_id")
        .limit(limit)
        .where("unknown_tax_rows > 0")
    )


def unresolved_totals(termed: DataFrame) -> DataFrame:
    return unknown_policies(termed).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unresolved_cancellation_rows"),
        F.count("*").alias("unresolved_cancellation_groups"),
    )


def assert_manifest_rows(df: DataFrame, manifest_rows: int) -> int:
    """Gate: the mirror must hold exactly what its manifest says."""
    n = df.count()
    if n != manifest_rows:
        raise ValueError(f"Warehouse analysis row mismatch: manifest={manifest_rows}, parquet={n}")
    return n


def manifest_gate(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per month of the mirror or of its manifest: rows stated, rows found, and whether
    they agree. Both have a column ``month``; the manifest also ``rows``."""
    found = df.groupBy("month").agg(F.count("*").alias("found_rows"))
    both = manifest.select("month", F.col("rows").alias("stated_rows")).join(found, "month", "full")
    stated, here = F.coalesce("stated_rows", F.lit(0)), F.coalesce("found_rows", F.lit(0))
    return both.select("month", stated.alias("stated_rows"), here.alias("found_rows"), (stated == here).alias("agrees"))


def assert_manifest(df: DataFrame, manifest: DataFrame) -> int:
    """Gate: every month of the mirror must hold exactly what its manifest says."""
    months = manifest_gate(df, manifest).orderBy("month").collect()  # one row a month
    bad = [f"{r.month}: manifest={r.stated_rows}, parquet={r.found_rows}" for r in months if not r.agrees]
    if bad:
        raise ValueError(f"Warehouse analysis row mismatch: {'; '.join(bad)}")
    return sum(r.found_rows for r in months)


def daily_volume(priced: DataFrame) -> DataFrame:
    """Per (hotel, day): priced official rows and their median, with yesterday's
    median and the mean count over those of the prior seven days that have rows.
    Frames are calendar ranges, never row offsets."""
    d = observed_day(priced.where(verified_market())).where((F.col("hotel_id") != "") & (F.col("nightly_adr_twd") > 0))
    daily = grouped_stats(d, ["hotel_id", "day"], {"adr": "nightly_adr_twd"}, extra=False).select(
        "hotel_id", "day", F.col("adr_n").alias("n"), F.col("adr_median").alias("adr")
    )
    # One row per hotel and day from here on.
    w = Window.partitionBy("hotel_id").orderBy(F.unix_date("day"))
    return daily.withColumns(
        {
            "baseline_count": F.avg("n").over(w.rangeBetween(-7, -1)),
            "yesterday_adr": F.max("adr").over(w.rangeBetween(-1, -1)),
        }
    )


def volume_warnings(priced: DataFrame, low_share: float = 0.5, spike: float = 0.5) -> DataFrame:
    """low_volume and price_spike on the latest day. Hotels without rows that day
    are judged too: nothing observed is less than half of any baseline."""
    d = observed_day(priced.where(verified_market())).where((F.col("hotel_id") != "") & (F.col("nightly_adr_twd") > 0))
    top = d.agg(F.max("day")).scalar()
    recent = d.withColumn("as_of", top).where(F.col("day") >= F.date_sub(top, 7))
    daily = grouped_stats(recent, ["hotel_id", "day", "as_of"], {"adr": "nightly_adr_twd"}, extra=False)
    back = F.datediff("as_of", "day")
    per_hotel = daily.groupBy("hotel_id", "as_of").agg(
        F.coalesce(F.max(F.when(back == 0, F.col("adr_n"))), F.lit(0)).alias("current_count"),
        F.avg(F.when(back.between(1, 7), F.col("adr_n"))).alias("baseline_count"),
        F.max(F.when(back == 0, F.col("adr_median"))).alias("current_adr_twd"),
        F.max(F.when(back == 1, F.col("adr_median"))).alias("previous_adr_twd"),
    )
    change = F.try_divide(F.col("current_adr_twd") - F.col("previous_adr_twd"), F.col("previous_adr_twd"))
    checks = F.filter(
        F.array(
            F.when(F.col("current_count") < F.col("baseline_count") * low_share, F.lit("low_volume")),
            F.when(F.abs(change) > spike, F.lit("price_spike")),
        ),
        lambda x: x.isNotNull(),
    )
    return per_hotel.withColumn("change_pct", change).withColumn("code", F.explode(checks))
