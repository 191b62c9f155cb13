"""Hotel catalog: merging sources, overlays, location sync, property mappings,
FX and CPI enrichment, localised names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratelens.functions.pricing import currency_code, fx_to_twd


def merge_catalog(earlier: DataFrame, later: DataFrame, daily: bool = False) -> DataFrame:
    """Later source over earlier, column by column. A hotel present in the later
    source takes all columns that source has, nulls included; ``enabled`` is true
    when either says so or the source is the daily one."""
    key = "hotel_id"
    a = earlier.select(*[F.col(c).alias(f"a_{c}") for c in earlier.columns])
    b = later.select(*[F.col(c).alias(f"b_{c}") for c in later.columns])
    here = F.col(f"b_{key}").isNotNull()
    out = [F.coalesce(f"b_{key}", f"a_{key}").alias(key)]
    for c in dict.fromkeys([*earlier.columns, *later.columns]):
        if c == key:
            continue
        old = F.col(f"a_{c}") if c in earlier.columns else None
        new = F.col(f"b_{c}") if c in later.columns else None
        if c == "enabled":
            flags = [F.coalesce(x, F.lit(False)) for x in (old, new) if x is not None] + [here & F.lit(daily)]
            merged = flags[0]
            for f in flags[1:]:
                merged = merged | f
        elif new is None:
            merged = old
        elif old is None:
            merged = new
        else:
            merged = F.when(here, new).otherwise(old)
        out.append(merged.alias(c))
    return a.join(b, F.col(f"a_{key}") == F.col(f"b_{key}"), "full_outer").select(*out)


def overlay(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """Overlay per-hotel facts (such as the opening year) on known hotels."""
    extra = [c for c in facts.columns if c != "hotel_id"]
    f = facts.select(F.col("hotel_id").alias("_h"), *[F.col(c).alias(f"_f_{c}") for c in extra])
    d = catalog.join(f, F.col("hotel_id") == F.col("_h"), "left")
    for c in extra:
        old = F.col(c) if c in catalog.columns else F.lit(None)
        d = d.withColumn(c, F.when(F.col("_h").isNotNull(), F.col(f"_f_{c}")).otherwise(old))
    return d.drop("_h", *[f"_f_{c}" for c in extra])


def orphans(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Overlay keys that the catalog does not know."""
    return facts.join(catalog.select("hotel_id"), "hotel_id", "left_anti").select("hotel_id")


def assert_no_orphans(facts: DataFrame, catalog: DataFrame) -> None:
    bad = orphans(facts, catalog).orderBy("hotel_id").take(20)
    if bad:
        raise ValueError("Opening-year records reference unknown hotels: " + ", ".join(r.hotel_id for r in bad))


def key_set_difference(expected: DataFrame, actual: DataFrame, key: str = "hotel_id") -> DataFrame:
    """Keys on one side only, marked 'missing' or 'extra'."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return (
        e.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
        .unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))
    )


def sync_tracking(locations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Locations with ``daily_tracked`` taken from the catalog and a change mark."""
    flag = catalog.select("hotel_id", F.coalesce("enabled", F.lit(False)).alias("_on"))
    d = locations.join(flag, "hotel_id")
    return d.withColumns(
        {"changed": ~F.col("daily_tracked").eqNullSafe(F.col("_on")), "daily_tracked": F.col("_on")}
    ).drop("_on")


def property_mapping(mapping: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable mappings, failure rows). Blank property ids are dropped, unknown
    hotels are reported."""
    m = mapping.withColumn("property_id", F.trim("property_id")).where("property_id <> ''")
    known = m.join(catalog.select("hotel_id"), "hotel_id", "left_semi")
    failed = m.join(catalog.select("hotel_id"), "hotel_id", "left_anti").select(
        "hotel_id", F.lit("").alias("lead_days"), F.lit("Unknown hotel mapping").alias("error")
    )
    return known, failed


def localized_names(df: DataFrame, names: DataFrame, name: str = "hotel_name") -> DataFrame:
    """Localised display name where one is known, else the name, else the id."""
    n = names.select("hotel_id", F.col("localized_name"))
    return df.join(n, "hotel_id", "left").withColumn(
        "display_name",
        F.coalesce(F.when(F.col("localized_name") != "", F.col("localized_name")), F.col(name), F.col("hotel_id")),
    ).drop("localized_name")


def with_fx(df: DataFrame, fx: DataFrame) -> DataFrame:
    """Fill ``fx_rate_to_twd`` from a published table (currency, foreign_per_twd);
    the local currency is 1 and a rate already on the row stays."""
    table = fx.select(currency_code("currency").alias("_code"), fx_to_twd("foreign_per_twd").alias("_fx"))
    d = df.withColumn("_mine", currency_code())
    return d.join(table, F.col("_mine") == F.col("_code"), "left").withColumn(
        "fx_rate_to_twd",
        F.coalesce(F.col("fx_rate_to_twd").cast("double"), F.when(F.col("_mine") == "TWD", F.lit(1.0)).otherwise(F.col("_fx"))),
    ).drop("_mine", "_code", "_fx")


def with_cpi(df: DataFrame, cpi: DataFrame, base_index: float) -> DataFrame:
    """Attach the index of the stay's observation month (month, cpi_index)."""
    c = cpi.select(F.col("month").alias("_month"), F.col("cpi_index").alias("_idx"))
    d = df.withColumn("_m", F.date_format("queried_at", "yyyy-MM"))
    return d.join(c, F.col("_m") == F.col("_month"), "left").withColumns(
        {"cpi_index": F.coalesce("cpi_index", F.col("_idx")), "cpi_base_index": F.coalesce("cpi_base_index", F.lit(base_index))}
    ).drop("_m", "_month", "_idx")
