"""Tax inclusion by reconciliation, and the tax split of inclusive totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.pricing import as_col, half_up
from ratelens.schema import UNKNOWN

MONEY_SQL = "decimal(18,4)"
# Absolute and relative tolerance of the reconciliation.
ABSOLUTE_TOLERANCE = "1"
RELATIVE_TOLERANCE = "0.0001"


def _money(c) -> Column:
    return as_col(c).try_cast(MONEY_SQL)


def _reconciles(total: Column, parts: list[Column]) -> Column:
    tolerance = F.greatest(
        F.lit(ABSOLUTE_TOLERANCE).cast(MONEY_SQL),
        (F.abs(total) * F.lit(RELATIVE_TOLERANCE).cast("decimal(5,4)")).cast("decimal(24,8)"),
    )
    return F.abs(total - reduce(lambda a, b: a + b, parts)) <= tolerance


def tax_inclusion(explicit="tax_inclusion", total="total_price", before="price_before_tax", service="service_charge", tax="tax") -> Column:
    """Explicit statement, else 'included' when the published parts add up."""
    given = as_col(explicit)
    t, b = _money(total), _money(before)
    zero = F.lit(0).cast(MONEY_SQL)
    parts, usable = [], F.lit(True)
    for c in (service, tax):
        raw, value = as_col(c), _money(c)
        usable = usable & (raw.isNull() | value.isNotNull())
        parts.append(F.coalesce(value, zero))
    some = as_col(service).isNotNull() | as_col(tax).isNotNull()
    sane = F.least(t, b, *parts) >= 0
    matched = t.isNotNull() & b.isNotNull() & some & usable & sane & _reconciles(t, [b, *parts])
    return (
        F.when(given.isin("included", "excluded"), given)
        .when(F.coalesce(matched, F.lit(False)), F.lit("included"))
        .otherwise(F.lit(UNKNOWN))
    )


# Property rules of the columnar mirror. A rule holds when every
# stated condition holds; ``any_of`` is method or URL evidence.
PROPERTY_TAX_RULES = (
    {"hotel_id": "capella_taipei", "source_method": "public_booking_page", "url_like": "%Hotel=47696%"},
    {"hotel_id": "grand_hotel_taipei", "source_method": None, "url_like": "%/webhotel-v5/1071%"},
)


def mirror_tax_inclusion(rules=PROPERTY_TAX_RULES) -> Column:
    """The mirror's variant: any stated value passes through, then property rules,
    then reconciliation against total_price or total_twd without a sign test."""
    given = F.trim(F.col("tax_inclusion"))
    total = F.coalesce(F.col("total_price"), F.col("total_twd")).try_cast("double")
    before = F.col("price_before_tax").try_cast("double")
    service, tax = (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("service_charge", "tax"))
    tolerance = F.greatest(F.lit(1.0), F.abs(total) * F.lit(0.0001))
    adds_up = (
        F.col("price_before_tax").isNotNull()
        & (F.col("service_charge").isNotNull() | F.col("tax").isNotNull())
        & (F.abs(total - (before + service + tax)) <= tolerance)
    )
    out = F.when((given != "") & (given != UNKNOWN), F.col("tax_inclusion"))
    for rule in rules:
        evidence = F.col("source_url").like(rule["url_like"])
        if rule["source_method"]:
            evidence = evidence | (F.col("source_method") == rule["source_method"])
        hit = (F.col("hotel_id") == rule["hotel_id"]) & (F.col("source_platform") == "official") & evidence
        out = out.when(F.coalesce(hit, F.lit(False)), F.lit("included"))
    return out.when(F.coalesce(adds_up, F.lit(False)), F.lit("included")).otherwise(F.lit(UNKNOWN))


# 10% service on the base, 5% tax on base plus service.
SERVICE_RATE = "0.10"
TAX_RATE = "0.05"
INCLUSIVE_FACTOR = "1.155"


def _split_columns(total: Column, prefix: str) -> dict[str, Column]:
    base = half_up(total.cast("decimal(18,4)") / F.lit(INCLUSIVE_FACTOR).cast("decimal(5,3)"))
    service = half_up(base * F.lit(SERVICE_RATE).cast("decimal(5,2)"))
    return {
        f"{prefix}base": base,
        f"{prefix}service": service,
        f"{prefix}tax": half_up(total.cast("decimal(18,4)") - base - service),
    }


def split_inclusive_total(df: DataFrame, total="total_price", prefix="split_") -> DataFrame:
    """Base, service and tax of a tax-inclusive total; the tax is the remainder."""
    return df.withColumns(_split_columns(as_col(total), prefix))


def add_tax_components(df: DataFrame, base="price_before_tax", prefix="added_") -> DataFrame:
    """The forward variant: service and tax on a published base, and their total."""
    b = as_col(base).cast("decimal(18,4)")
    service = half_up(b * F.lit(SERVICE_RATE).cast("decimal(5,2)"))
    tax = half_up((b + service) * F.lit(TAX_RATE).cast("decimal(5,2)"))
    return df.withColumns({f"{prefix}service": service, f"{prefix}tax": tax, f"{prefix}total": b + service + tax})
