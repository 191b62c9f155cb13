"""Natural key, deduplication and latest-batch selection.

``row_number() = 1`` is planned with a group limit before the shuffle, so each
map task sends at most one row per key: many copies of one key cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.functions.pricing import as_date, currency_code, source_key, source_of
from ratelens.schema import LEGACY_DEFAULTS
from ratelens.session import cut_lineage

KEY_COLUMNS = (
    "key_hotel", "key_source", "key_check_in", "key_check_out", "key_rooms", "key_adults",
    "key_children", "key_room", "key_plan", "key_currency", "key_day",
)


def _code_or_name(code: str, name: str) -> Column:
    c = F.col(code)
    return F.when(c.isNotNull() & (c != ""), c).otherwise(
        F.concat(F.lit("name:"), F.coalesce(F.col(name), F.lit("")))
    )


def _party(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(str(LEGACY_DEFAULTS[name]))).otherwise(F.trim(text))


def _day(name: str) -> Column:
    return F.coalesce(F.date_format(as_date(name), "yyyy-MM-dd"), F.lit(""))


def key_expressions() -> dict[str, Column]:
    """The eleven parts of the stable daily natural key."""
    parts = (
        F.coalesce(F.col("hotel_id"), F.lit("")),
        source_key(),
        _day("check_in"),
        _day("check_out"),
        _party("rooms"),
        _party("adults"),
        _party("children"),
        _code_or_name("room_type_code", "room_type_name"),
        _code_or_name("rate_plan_code", "rate_plan_name"),
        currency_code(),
        _day("queried_at"),
    )
    return dict(zip(KEY_COLUMNS, parts))


def with_natural_key(df: DataFrame) -> DataFrame:
    return df.withColumns(key_expressions())


def _tie_break(df: DataFrame) -> list[str]:
    return [c for c in ("observation_id", "total_price") if c in df.columns]


def with_key_digest(df: DataFrame) -> DataFrame:
    """``df`` with the SHA-256 of the natural key as ``_digest``: rows are sorted and shuffled
    with it instead of the key's eleven texts, which are wider than most rows. JSON keeps
    the parts, and null from empty, apart."""
    key = F.struct(*[e.alias(c) for c, e in key_expressions().items()])
    return df.withColumn("_digest", F.unhex(F.sha2(F.to_json(key), 256)))


def deduplicate(df: DataFrame, keep: str = "latest") -> DataFrame:
    """One row per natural key. Ties on ``queried_at`` are settled by
    ``observation_id`` and ``total_price`` so that reruns agree."""
    return one_per_digest(with_key_digest(df), keep).drop("_digest")


def one_per_digest(keyed: DataFrame, keep: str = "latest") -> DataFrame:
    """``deduplicate`` of rows with their ``_digest``, which stays."""
    if keep not in ("first", "latest"):
        raise ValueError("keep must be 'first' or 'latest'")
    order = ["queried_at", *_tie_break(keyed)]
    by = [F.col(c).desc_nulls_last() if keep == "latest" else F.col(c).asc_nulls_last() for c in order]
    w = Window.partitionBy("_digest").orderBy(*by)
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_counts(df: DataFrame, keep: str = "latest") -> DataFrame:
    """Rows before and after deduplication, per month of observation."""
    day = F.col("key_day")
    per_key = with_natural_key(df).groupBy(*KEY_COLUMNS).agg(F.count("*").alias("n"))
    return per_key.groupBy(F.substring(day, 1, 7).alias("month")).agg(
        F.sum("n").alias("rows_before"), F.count("*").alias("rows_after")
    )


def latest_batches(df: DataFrame, window_minutes: int = 30, strict_legacy: bool = True) -> DataFrame:
    """Newest batch of every (source, hotel) stream.

    The newest row decides: with a run id the batch is that run, without one it is
    the rows of the last ``window_minutes``. ``strict_legacy`` additionally asks
    that those rows carry no run id themselves. The newest row per stream is a
    map-side combined aggregate, so a hot stream is never sorted in one task. It is
    written before the rows are joined to it, as the texts of ``per_distinct`` are: few
    streams are broadcast, and their rows are not dealt out by stream."""
    src, hotel = source_of(), F.coalesce(F.col("hotel_id"), F.lit(""))
    stamped = df.where(F.col("queried_at").isNotNull()).withColumns({"_src": src, "_hotel": hotel})
    order = F.struct("queried_at", *_tie_break(df))
    newest = stamped.groupBy("_src", "_hotel").agg(
        F.max_by(F.col("run_id"), order).alias("_run"), F.max("queried_at").alias("_top")
    ).withColumn("_run", F.when(F.col("_run") != "", F.col("_run")))
    newest = cut_lineage(newest, "newest")
    recent = F.col("queried_at") >= F.col("_top") - F.expr(f"INTERVAL {int(window_minutes)} MINUTES")
    if strict_legacy:
        recent = recent & (F.col("run_id").isNull() | (F.col("run_id") == ""))
    in_batch = F.when(F.col("_run").isNotNull(), F.col("run_id") == F.col("_run")).otherwise(recent)
    return (
        stamped.join(newest, ["_src", "_hotel"]).where(in_batch).drop("_src", "_hotel", "_run", "_top")
    )
