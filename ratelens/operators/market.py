"""Hotel-equal-weighted market indicators, periods, movers and rollups.

Per-hotel medians use the skew-safe selection of ``stats``. The second level runs
over one value per hotel, which the hotel catalog bounds, so there the built-in
``median`` is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratelens.functions.pricing import core_room, positive, source_of, verified_market
from ratelens.operators.parity import rate_parity
from ratelens.operators.stats import beside, by_grains, count_cube, cube_stats, grouped_stats

IDENTITY = ["hotel_id", "hotel_name", "city", "district"]


def observed_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("queried_at"))


def market_summary(priced: DataFrame) -> DataFrame:
    """One row: mean of hotel means, median of hotel medians (also per square
    metre and CPI-adjusted), rounded half-even. Rows without hotel or price count
    as observations; hotels without a price count as hotels."""
    official = priced.where(verified_market())
    known = official.where(F.col("hotel_id").isNotNull() & (F.col("hotel_id") != ""))
    per_hotel = grouped_stats(
        known,
        ["hotel_id"],
        {"adr": "nightly_adr_twd", "unit": "price_per_sqm", "cpi": "cpi_adjusted_nightly_twd"},
    )
    levels = per_hotel.agg(
        F.bround(F.avg("adr_mean"), 0).alias("average_adr_twd"),
        F.bround(F.median("adr_median"), 0).alias("median_adr_twd"),
        F.bround(F.median("unit_median"), 0).alias("median_per_sqm_twd"),
        F.bround(F.median("cpi_median"), 0).alias("median_cpi_adjusted_twd"),
    )
    totals = official.agg(
        F.count("*").alias("observations"),
        F.countDistinct(F.when(F.col("hotel_id") != "", F.col("hotel_id"))).alias("hotels"),
    )
    return beside(totals, levels)


def _priced_hotels(df: DataFrame) -> DataFrame:
    return df.where((F.col("hotel_id") != "") & F.col("nightly_adr_twd").isNotNull())


def period_medians(df: DataFrame, period: str) -> DataFrame:
    """Per (period, hotel): median and count of nightly prices."""
    stats = grouped_stats(_priced_hotels(df), [period, "hotel_id"], {"adr": "nightly_adr_twd"}, extra=False)
    return stats.select(period, "hotel_id", F.col("adr_median").alias("median_twd"), F.col("adr_n").alias("observations"))


def hotel_period_medians(df: DataFrame, period: str) -> DataFrame:
    """``period_medians`` with the name last seen in the period."""
    names = _priced_hotels(df).groupBy(period, "hotel_id").agg(
        F.max_by("hotel_name", F.struct("queried_at", "observation_id")).alias("hotel_name")
    )
    return period_medians(df, period).join(names, [period, "hotel_id"]).select(
        period, "hotel_id", "hotel_name", "median_twd", "observations"
    )


def _equal_weights(medians: DataFrame, period: str) -> DataFrame:
    return medians.groupBy(period).agg(
        F.median("median_twd").alias("market_median_twd"),
        F.avg("median_twd").alias("market_average_twd"),
        F.count("*").alias("hotels"),
        F.sum("observations").alias("observations"),
    )


def period_market(df: DataFrame, period: str) -> DataFrame:
    """One row per period, each hotel weighing the same."""
    return _equal_weights(period_medians(df, period), period)


def _latest_day(df: DataFrame):
    """The newest observation day as a scalar subquery: it is evaluated once and
    its value is pushed into the scans that filter on it."""
    return df.agg(F.max("day").alias("latest_day")).scalar()


def _dated(priced: DataFrame) -> DataFrame:
    return observed_day(priced.where(verified_market())).where(F.col("day").isNotNull() & (F.col("nightly_adr_twd") > 0))


def weekly_rows(priced: DataFrame) -> DataFrame:
    """Official, priced rows of the latest seven days ('current') and the seven
    before ('previous')."""
    dated = _dated(priced)
    top = _latest_day(dated)
    period = F.when(F.col("day") > F.date_sub(top, 7), F.lit("current")).when(
        F.col("day") > F.date_sub(top, 14), F.lit("previous")
    )
    return dated.withColumn("period", period).where("period is not null")


def weekly_digest(priced: DataFrame) -> DataFrame:
    """One row with both periods, the change, and the number of hotels that have a
    price in both; an empty history yields ``available = false``. A missing previous
    period leaves the change null."""
    medians = period_medians(weekly_rows(priced), "period")
    market = _equal_weights(medians, "period")

    def side(name, col):
        return F.max(F.when(F.col("period") == name, F.col(col)))

    both = market.agg(
        *[
            side(p, c).alias(f"{p}_{c}")
            for p in ("current", "previous")
            for c in ("market_median_twd", "market_average_twd", "hotels", "observations")
        ]
    )
    per_hotel = medians.groupBy("hotel_id").agg(side("current", "median_twd").alias("now"), side("previous", "median_twd").alias("past"))
    comparable = per_hotel.agg(F.count_if(F.col("now").isNotNull() & (F.col("past") != 0)).alias("comparable_hotels"))
    # the same subquery as in weekly_rows, so it is evaluated once
    latest = both.withColumn("current_end", _latest_day(_dated(priced)))
    change = F.try_divide(
        F.col("current_market_median_twd") - F.col("previous_market_median_twd"), F.col("previous_market_median_twd")
    )
    return beside(latest, comparable).select(
        F.col("current_market_median_twd").isNotNull().alias("available"),
        F.date_sub("current_end", 6).alias("current_start"),
        "current_end",
        F.date_sub("current_end", 13).alias("previous_start"),
        F.date_sub("current_end", 7).alias("previous_end"),
        *both.columns,
        "comparable_hotels",
        change.alias("change_pct"),
        F.when(F.col("current_market_median_twd").isNull(), F.lit("no_history")).alias("reason"),
    )


def weekly_movers(priced: DataFrame, limit: int | None = 5) -> DataFrame:
    """Hotels present in both weeks, by absolute change; the report shows five."""
    m = hotel_period_medians(weekly_rows(priced), "period")
    now = m.where("period = 'current'").select(
        "hotel_id", F.col("hotel_name").alias("n1"), F.col("median_twd").alias("current_median_twd")
    )
    past = m.where("period = 'previous'").select(
        "hotel_id", F.col("hotel_name").alias("n0"), F.col("median_twd").alias("previous_median_twd")
    )
    out = now.join(past, "hotel_id").where("previous_median_twd <> 0").select(
        "hotel_id",
        F.coalesce("n1", "n0").alias("hotel_name"),
        "current_median_twd",
        "previous_median_twd",
        ((F.col("current_median_twd") - F.col("previous_median_twd")) / F.col("previous_median_twd")).alias("change_pct"),
    )
    if limit is None:
        return out
    return out.orderBy(F.abs("change_pct").desc(), "hotel_id").limit(limit)


def lead_time_curve(priced: DataFrame) -> DataFrame:
    """Market median per lead time over the current week."""
    now = weekly_rows(priced).where("period = 'current' and lead_days is not null")
    per_hotel = grouped_stats(now, ["lead_days", "hotel_id"], {"adr": "nightly_adr_twd"}, extra=False)
    return per_hotel.where("hotel_id <> ''").groupBy("lead_days").agg(
        F.median("adr_median").alias("market_median_twd"), F.count("*").alias("hotels")
    )


def equal_weight_median(df: DataFrame, by: list[str], core_only: bool = False) -> DataFrame:
    """Median of hotel medians per ``by`` group, optionally of core rooms only."""
    rows = df.where(core_room()) if core_only else df
    rows = rows.where((F.col("hotel_id") != "") & F.col("nightly_adr_twd").isNotNull())
    per_hotel = grouped_stats(rows, [*by, "hotel_id"], {"adr": "nightly_adr_twd"}, extra=False)
    return per_hotel.groupBy(*by).agg(F.median("adr_median").alias("median_twd"), F.count("*").alias("hotels"))


def comparison_days(priced: DataFrame, back: int = 7) -> DataFrame:
    """Official rows of the latest day ('current') and of ``back`` days earlier
    ('previous'), carrying the latest day."""
    dated = observed_day(priced.where(verified_market())).where("day is not null")
    top = _latest_day(dated)
    side = F.when(F.col("day") == top, F.lit("current")).when(F.col("day") == F.date_sub(top, back), F.lit("previous"))
    return dated.withColumns({"side": side, "latest_day": top}).where("side is not null")


def forward_medians(priced: DataFrame, horizon: int = 30) -> DataFrame:
    """Per (side, hotel): median of stays within ``horizon`` days of the latest day."""
    days = comparison_days(priced).where(
        F.col("check_in").between(F.col("latest_day"), F.date_add("latest_day", horizon))
    )
    return hotel_period_medians(days, "side")


def daily_movers(priced: DataFrame) -> DataFrame:
    m = forward_medians(priced)
    now = m.where("side = 'current'").select(
        "hotel_id", F.col("hotel_name").alias("n1"), F.col("median_twd").alias("current_median_twd")
    )
    past = m.where("side = 'previous'").select(
        "hotel_id", F.col("hotel_name").alias("n0"), F.col("median_twd").alias("previous_median_twd")
    )
    return now.join(past, "hotel_id").where("previous_median_twd <> 0").select(
        "hotel_id",
        F.coalesce("n1", "n0").alias("hotel_name"),
        "current_median_twd",
        "previous_median_twd",
        ((F.col("current_median_twd") - F.col("previous_median_twd")) / F.col("previous_median_twd")).alias("change_pct"),
    )


def daily_digest(priced: DataFrame, keyed: DataFrame, normal_gap: float = 0.05) -> DataFrame:
    """One row: core-room change against a week ago, largest rise and fall, and the
    share of like-for-like gaps within ``normal_gap``. ``keyed`` carries the
    comparison key of every row, all sources."""
    core = equal_weight_median(comparison_days(priced), ["side"], core_only=True).agg(
        F.max(F.when(F.col("side") == "current", F.col("median_twd"))).alias("core_current"),
        F.max(F.when(F.col("side") == "previous", F.col("median_twd"))).alias("core_previous"),
    )
    up = F.struct(F.col("change_pct"), F.col("hotel_id"))
    movers = daily_movers(priced).agg(
        F.max(up).alias("rise"), F.min(up).alias("fall"), F.count("*").alias("mover_hotels")
    )
    gap = F.col("gap_percent")
    parity = rate_parity(keyed).where(gap.isNotNull()).agg(
        F.count("*").alias("parity_products"), F.count_if(F.abs(gap) <= normal_gap).alias("parity_normal")
    )
    latest = observed_day(priced.where(verified_market())).agg(F.max("day").alias("latest_date"))
    return beside(latest, core, movers, parity).select(
        "latest_date",
        F.date_sub("latest_date", 7).alias("comparison_date"),
        F.try_divide(F.col("core_current") - F.col("core_previous"), F.col("core_previous")).alias("core_adr_change_pct"),
        F.col("rise.hotel_id").alias("largest_increase_hotel"),
        F.col("rise.change_pct").alias("largest_increase_pct"),
        F.col("fall.hotel_id").alias("largest_decrease_hotel"),
        F.col("fall.change_pct").alias("largest_decrease_pct"),
        "mover_hotels",
        "parity_products",
        F.try_divide(F.col("parity_normal").cast("double"), F.col("parity_products").cast("double")).alias("parity_normal_rate"),
    )


GRAINS = {"daily": ["day"], "hotel": [], "lead": ["lead_days"]}
MEASURES = ["adr", "core", "unit", "days"]


def history_cube(priced: DataFrame, keys: list[str]) -> DataFrame:
    """The count cube of the official, priced history by hotel and ``keys`` (of day and
    lead time): nightly prices, those of core rooms, prices per square metre, and the
    day as a number. It can be written and kept; cubes of later days add up with it."""
    rows = observed_day(priced.where(verified_market())).where(
        F.col("queried_at").isNotNull() & (F.col("nightly_adr_twd") > 0)
    )
    measures = {
        "adr": "nightly_adr_twd",
        "core": F.when(core_room(), F.col("nightly_adr_twd")),
        "unit": positive("price_per_sqm"),
        "days": F.datediff("day", F.lit("1970-01-01").cast("date")),
    }
    return count_cube(rows, [*keys, *IDENTITY], measures)


def _rollup(cube: DataFrame, keys: list[str]) -> DataFrame:
    return cube_stats(cube, keys, MEASURES).select(
        *keys,
        F.col("adr_n").alias("observations"),
        F.col("adr_mean").alias("average_twd"),
        F.col("adr_median").alias("median_twd"),
        F.col("core_median").alias("core_median_twd"),
        F.col("unit_median").alias("median_per_sqm_twd"),
        F.col("days_distinct").alias("days"),
    )


def history_rollup(priced: DataFrame, grain: str) -> DataFrame:
    """Count, mean, median, core median and unit median at one of three grains:
    day x hotel, hotel (with the number of days), hotel x lead time."""
    keys = GRAINS[grain]
    cube = history_cube(priced, keys)
    if grain == "lead":
        cube = cube.where("lead_days is not null")
    out = _rollup(cube, [*keys, *IDENTITY])
    return out if grain == "hotel" else out.drop("days")


def rollups_of_cube(cube: DataFrame) -> DataFrame:
    """All three grains from a cube by day and lead time, as one table marked by
    ``grain``: keys that a grain lacks are null, and ``days`` is that of ``hotel``."""
    grained = by_grains(cube, GRAINS, ["day", "lead_days"]).where("grain <> 'lead' or lead_days is not null")
    out = _rollup(grained, ["grain", "day", "lead_days", *IDENTITY])
    return out.withColumn("days", F.when(F.col("grain") == "hotel", F.col("days")))


def history_rollups(priced: DataFrame) -> DataFrame:
    """All three grains in one pass over the rows."""
    return rollups_of_cube(history_cube(priced, ["day", "lead_days"]))


def latest_rows_of_history(history: DataFrame, latest: DataFrame, keyed: bool = False) -> DataFrame:
    """History rows whose ``queried_at`` occurs among the latest batches. The
    default compares timestamps only, as published; ``keyed`` also asks for the
    same source and hotel."""
    on = ["queried_at"] + (["source_platform", "hotel_id"] if keyed else [])
    return history.join(latest.select(*on).distinct(), on, "left_semi")


def latest_summary(latest: DataFrame, history: DataFrame) -> DataFrame:
    """One row describing the latest batches and their market summary."""
    both_known = F.when((F.col("hotel_id") != "") & (F.col("room_type_code") != ""), F.struct("hotel_id", "room_type_code"))
    counts = latest.agg(
        F.max("queried_at").alias("latest_queried_at"),
        F.count("*").alias("record_count"),
        F.countDistinct(F.when(F.col("hotel_id") != "", F.col("hotel_id"))).alias("hotel_count"),
        F.countDistinct(both_known).alias("room_type_count"),
    )
    official = latest_rows_of_history(history, latest).where(source_of() == "official")
    return beside(counts, market_summary(official))
