"""Nested availability payloads and bulk quotation rows as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.offers import area_from_unit
from ratelens.operators.containment import contained_labels
from ratelens.schema import MONEY, conform

# Objects whose shape varies by version are kept as JSON text and read by path.
_ENVELOPE = "data struct<currency:string,url:string,deep_link_url:string,products:array<string>,rooms:array<string>>"


def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _amount(json: Column, path: str) -> Column:
    """A price is a number, or an object with one amount per currency role."""
    plain = _at(json, path).try_cast(MONEY)
    return F.coalesce(
        plain, _at(json, f"{path}.booker_currency").try_cast(MONEY), _at(json, f"{path}.accommodation_currency").try_cast(MONEY)
    )


def _name(json: Column, path: str) -> Column:
    """A name is text, or a map by language whose first entry counts."""
    raw = _at(json, path)
    first = F.get(F.map_values(F.from_json(raw, "map<string,string>")), 0)
    return F.when(raw.startswith("{"), first).otherwise(raw)


def _room(code: Column, path: str, of) -> Column:
    hit = F.get(F.filter("_rooms", lambda r: _at(r, "$.id") == code), 0)
    return F.when(code.isNotNull(), of(hit, path))


def policy_text(product: Column) -> Column:
    kind = _at(product, "$.policies.cancellation.type")
    until = _at(product, "$.policies.cancellation.free_cancellation_until")
    return F.when(
        (kind == "free_cancellation") & (until != ""), F.concat(F.lit("Free cancellation until "), until)
    ).otherwise(F.nullif(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("")))


def meal_flag(product: Column) -> Column:
    plan = F.lower(F.coalesce(_at(product, "$.policies.meal_plan.plan"), _at(product, "$.policies.meal_plan.type")))
    denied = plan.contains("without") | plan.contains("excluded") | plan.contains("no_")
    return F.when(plan.contains("breakfast"), ~denied).when(plan.isin("no_meal", "room_only"), F.lit(False))


def availability_observations(
    payloads: DataFrame, platform: str = "booking_com", label: str = "Booking.com", home: str = "https://www.booking.com/"
) -> DataFrame:
    """One row per priced product. ``payloads``: payload (JSON text), hotel_id,
    hotel_name, city, district, currency (the hotel's), source_property_id, check_in,
    check_out, adults, queried_at."""
    d = payloads.withColumn("_d", F.from_json("payload", _ENVELOPE)["data"]).withColumns(
        {"_rooms": F.coalesce("_d.rooms", F.array().cast("array<string>")), "_p": F.explode("_d.products")}
    )
    p = F.col("_p")
    room = _at(p, "$.room")
    is_object = room.startswith("{")
    code = F.nullif(F.when(is_object, _at(p, "$.room.id")).otherwise(room), F.lit(""))
    d = d.withColumns({"_total": _amount(p, "$.price.total"), "_code": code}).where("_total is not null")
    known_name = _room(F.col("_code"), "$.name", _name)
    size = _room(F.col("_code"), "$.size", lambda r, _: area_from_unit(_at(r, "$.size.value"), _at(r, "$.size.unit")))
    name = F.coalesce(
        F.nullif(F.when(is_object, _name(p, "$.room.name")), F.lit("")),
        F.nullif(known_name, F.lit("")),
        F.concat(F.lit("Room "), F.col("_code")),
        F.lit("Available room"),
    )
    d = d.withColumns(
        {
            "room_type_name": name,
            "room_size_sqm": size,
            "breakfast_included": meal_flag(p),
            "cancellation_policy": policy_text(p),
            "rate_plan_code": F.nullif(_at(p, "$.id"), F.lit("")),
            "price_before_tax": _amount(p, "$.price.base"),
            "_currency": F.coalesce(F.nullif(F.col("_d.currency"), F.lit("")), F.col("currency")),
        }
    )
    meal = F.when(F.col("breakfast_included"), F.lit("breakfast included")).when(~F.col("breakfast_included"), F.lit("room only"))
    stamp = F.date_format("queried_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    key = F.concat_ws(
        ":", F.lit(platform), "hotel_id", "source_property_id", F.date_format("check_in", "yyyy-MM-dd"),
        F.coalesce("rate_plan_code", "room_type_name"), stamp,
    )
    out = d.withColumns(
        {
            "observation_id": F.substring(F.sha2(key, 256), 1, 24),
            "lead_days": F.datediff("check_in", F.to_date("queried_at")),
            "nights": F.datediff("check_out", "check_in"),
            "rooms": F.lit(1),
            "children": F.lit(0),
            "room_type_code": F.col("_code"),
            "rate_plan_name": F.concat_ws(" · ", F.lit(label), meal, F.col("cancellation_policy")),
            "total_price": F.col("_total"),
            "tax_inclusion": F.lit("included"),
            "currency": F.col("_currency"),
            "source_platform": F.lit(platform),
            "source_method": F.lit("partner_api"),
            "source_url": F.coalesce(F.nullif(F.col("_d.url"), F.lit("")), F.nullif(F.col("_d.deep_link_url"), F.lit("")), F.lit(home)),
            "status": F.lit("live"),
            "fx_rate_to_twd": F.when(F.col("_currency") == "TWD", F.lit(1)),
        }
    )
    return conform(out.drop("payload", "_d", "_p", "_rooms", "_total", "_code", "_currency"))


def quotation_observations(quotes: DataFrame, rooms: DataFrame) -> DataFrame:
    """Bulk quotation rows (hotel_id, room, rate, total_price, adults, currency,
    check_in, check_out, queried_at ...) with a room table (hotel_id, room, room_name,
    size_sqm). Rows that lack room, rate or amount are skipped; unlisted codes are
    named by themselves with blanks for dashes."""
    q = quotes.withColumns({"room": F.trim("room"), "rate": F.trim("rate")}).where(
        "room <> '' and rate <> '' and total_price is not null"
    )
    d = q.join(rooms.select("hotel_id", "room", "room_name", "size_sqm"), ["hotel_id", "room"], "left")
    key = F.concat_ws(
        ":", "hotel_id", F.date_format("check_in", "yyyy-MM-dd"), "room", "rate",
        F.date_format("queried_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    )
    out = d.withColumns(
        {
            "observation_id": F.substring(F.sha2(key, 256), 1, 24),
            "room_type_code": F.col("room"),
            "room_type_name": F.coalesce("room_name", F.replace("room", F.lit("-"), F.lit(" "))),
            "room_size_sqm": F.col("size_sqm"),
            "rate_plan_code": F.col("rate"),
            "rate_plan_name": F.replace("rate", F.lit("-"), F.lit(" ")),
            "lead_days": F.datediff("check_in", F.to_date("queried_at")),
            "nights": F.datediff("check_out", "check_in"),
            "currency": F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("TWD")),
            "tax_inclusion": F.lit("unknown"),
            "source_platform": F.lit("official"),
            "source_method": F.lit("public_booking_api"),
            "status": F.lit("live"),
            "fx_rate_to_twd": F.lit(1),
        }
    )
    return conform(out.drop("room", "rate", "room_name", "size_sqm"))


def size_by_known_name(df: DataFrame, known: DataFrame, name: str = "room_type_name") -> DataFrame:
    """Room size from the name: exact, else the longest known name it contains.

    ``known``: hotel_id, known_name, size_sqm. Distinct names and known names meet over a
    q-gram index (see ``containment``), so names are never paired with all sizes."""
    held = contained_labels(df.select("hotel_id", name), known, ["hotel_id"], name, "known_name")
    best = held.join(known, ["hotel_id", "known_name"]).groupBy("hotel_id", name).agg(
        F.max_by("size_sqm", F.struct(F.length("known_name"), "known_name")).alias("known_size_sqm")
    )
    return df.join(best, ["hotel_id", name], "left")
