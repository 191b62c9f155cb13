"""Stay length, currency and price normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ratelens.schema import DEFAULT_SOURCE, PLAUSIBLE_NIGHTLY_TWD, SIZE_BANDS, UNKNOWN


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """The value as a finite-or-null double; text that is not numeric is null."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def positive(c) -> Column:
    x = number(c)
    return F.when(x > 0, x)


def as_date(c) -> Column:
    return as_col(c).try_cast("date")


def source_of(c="source_platform") -> Column:
    """Rows written before the column existed are official-site rows."""
    raw = as_col(c)
    return F.when(raw.isNull() | (raw == ""), F.lit(DEFAULT_SOURCE)).otherwise(raw)


def source_key(c="source_platform") -> Column:
    return F.lower(F.trim(source_of(c)))


def currency_code(c="currency") -> Column:
    code = F.upper(F.trim(F.coalesce(as_col(c), F.lit(""))))
    return F.when(code == "NTD", F.lit("TWD")).otherwise(code)


def is_local_currency(c="currency") -> Column:
    raw = as_col(c)
    code = F.upper(F.when(raw.isNull() | (raw == ""), F.lit("TWD")).otherwise(raw))
    return code.isin("TWD", "NTD")


def stay_nights(check_in="check_in", check_out="check_out", nights="nights", prefer="interval") -> Column:
    """Positive stay length. ``interval`` trusts the dates first, ``stored`` is the
    mirror's rule and trusts the stored number first (and does not default it)."""
    gap = F.datediff(as_date(check_out), as_date(check_in))
    raw = as_col(nights)
    stored = raw.try_cast("int")
    if prefer == "stored":
        return F.coalesce(stored, gap)
    if prefer != "interval":
        raise ValueError("prefer must be 'interval' or 'stored'")
    fallback = F.when(raw.isNull(), F.lit(1)).otherwise(stored)
    return F.when(gap > 0, gap).otherwise(F.when(fallback > 0, fallback))


def total_twd(total="total_twd", price="total_price", currency="currency", fx="fx_rate_to_twd") -> Column:
    """The stay total in TWD: given, else the local price, else price x FX."""
    local = number(price)
    return (
        F.when(as_col(total).isNotNull(), number(total))
        .when(is_local_currency(currency), local)
        .otherwise(local * number(fx))
    )


def nightly_adr_twd(**columns) -> Column:
    """Stay total per room-night in TWD; null when not positive."""
    total = total_twd(**{k: v for k, v in columns.items() if k in ("total", "price", "currency", "fx")})
    nights = stay_nights(**{k: v for k, v in columns.items() if k in ("check_in", "check_out", "nights")})
    return F.when(total > 0, total / nights)


def mirror_nightly_adr_twd(adr="nightly_adr_twd", total="total_twd", price="total_price", **stay) -> Column:
    """The columnar mirror's rule: stored value first, and no FX conversion."""
    nights = stay_nights(prefer="stored", **stay)
    return F.coalesce(
        as_col(adr).try_cast("double"),
        F.try_divide(F.coalesce(as_col(total), as_col(price)).try_cast("double"), nights.cast("double")),
    )


def nightly_price_per_sqm(nightly: Column, size="room_size_sqm", legacy="price_per_sqm", nights: Column | None = None) -> Column:
    """Nightly price per square metre. A missing or non-numeric size falls back to
    the stored unit price per night; a known but non-positive size does not."""
    area = number(size)
    unit = positive(legacy) / (nights if nights is not None else stay_nights())
    return F.when(area.isNull(), unit).when(area > 0, nightly / area)


def cpi_adjusted_twd(nightly: Column, index="cpi_index", base="cpi_base_index", stored="cpi_adjusted_twd", nights: Column | None = None) -> Column:
    live = nightly * positive(base) / positive(index)
    return F.coalesce(live, positive(stored) / (nights if nights is not None else stay_nights()))


def fx_to_twd(foreign_per_twd) -> Column:
    """Published tables hold foreign units per TWD, so the rate to TWD is the
    reciprocal. A non-positive rate is an error, not a price."""
    rate = as_col(foreign_per_twd)
    bad = F.raise_error(F.concat(F.lit("invalid FX rate: "), rate.cast("string"))).cast("double")
    return F.when(rate.isNull(), F.lit(None).cast("double")).when(rate > 0, F.lit(1.0) / rate).otherwise(bad)


def display_amount(value, rate) -> Column:
    """Display conversion; a currency without a usable rate shows TWD unchanged."""
    r = number(rate)
    return number(value) * F.when(r.isNull() | (r == 0), F.lit(1.0)).otherwise(r)


def size_band(size="room_size_sqm", band: str | Column | None = "size_band") -> Column:
    """Existing known band, else the band of the size; unknown is never '<45'."""
    area = number(size)
    small, core, large, suite = (F.lit(b) for b in SIZE_BANDS)
    derived = (
        F.when(area.isNull() | (area <= 0), F.lit(UNKNOWN))
        .when(area < 45, small)
        .when(area < 60, core)
        .when(area < 80, large)
        .otherwise(suite)
    )
    if band is None:
        return derived
    given = as_col(band)
    return F.when(given.isNotNull() & (given != "") & (given != UNKNOWN), given).otherwise(derived)


def occupancy_key(rooms="rooms", adults="adults", children="children") -> Column:
    r, a, c = (as_col(x).try_cast("int") for x in (rooms, adults, children))
    text = F.concat(r.cast("string"), F.lit("r-"), a.cast("string"), F.lit("a-"), c.cast("string"), F.lit("c"))
    return F.when((r > 0) & (a > 0) & (c >= 0), text).otherwise(F.lit(UNKNOWN))


def priced(df, prefer_nights: str = "interval"):
    """Add ``nights``, ``total_twd``, ``nightly_adr_twd``, ``price_per_sqm`` and
    ``cpi_adjusted_nightly_twd`` once, so that later operators read columns."""
    nights = stay_nights(prefer=prefer_nights)
    return (
        df.withColumns({"_nights": nights, "_total": total_twd()})
        .withColumn("_nightly", F.when(F.col("_total") > 0, F.col("_total") / F.col("_nights")))
        .withColumns(
            {
                "_unit": nightly_price_per_sqm(F.col("_nightly"), nights=F.col("_nights")),
                "_cpi": cpi_adjusted_twd(F.col("_nightly"), nights=F.col("_nights")),
            }
        )
        .withColumns(
            {
                "nights": F.col("_nights"),
                "total_twd": F.col("_total"),
                "nightly_adr_twd": F.col("_nightly"),
                "price_per_sqm": F.col("_unit"),
                "cpi_adjusted_nightly_twd": F.col("_cpi"),
            }
        )
        .drop("_nights", "_total", "_nightly", "_unit", "_cpi")
    )


def plausible(nightly="nightly_adr_twd") -> Column:
    """A filter: unknown prices do not pass."""
    low, high = PLAUSIBLE_NIGHTLY_TWD
    return as_col(nightly).between(low, high)


def publishable(status="status", nightly="nightly_adr_twd") -> Column:
    """Only explicit live rows with a plausible nightly price are published. Plain
    comparisons, so that the filter reaches the scan of the mirror."""
    return (as_col(status) == "live") & plausible(nightly)


def verified_market(source="source_platform") -> Column:
    """Market indicators describe direct official rates only."""
    return source_key(source) == DEFAULT_SOURCE


def core_room(size="room_size_sqm") -> Column:
    area = positive(size)
    return F.coalesce((area >= 45) & (area < 60), F.lit(False))


def half_up(c, scale: int = 0) -> Column:
    """Half-up rounding on a decimal, as money and area parsers round."""
    return F.round(as_col(c).cast(T.DecimalType(28, 10)), scale)
