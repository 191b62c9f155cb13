"""Dashboard aggregations: filters, heatmap, trends, room catalog, facets,
service charge, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.pricing import core_room, positive, size_band, source_of
from ratelens.operators.stats import grouped_medians, grouped_stats

# Geographic order of places; others follow by name.
CITY_ORDER = ("Taipei", "New Taipei", "NewTaipei", "Hsinchu", "Taichung")
DISTRICT_ORDER = ("Beitou", "Shilin", "Zhongshan", "Songshan")


def select_rates(
    df: DataFrame, *, city=None, district=None, hotels=None, band=None, leads=None, source=None, ignore_band: bool = False
) -> DataFrame:
    """The filters of the API and the dashboards. Plain predicates, so they reach
    the scan. ``hotels`` is one id or a competitor set."""
    out = df
    if city:
        out = out.where(F.col("city") == city)
    if district:
        out = out.where(F.col("district") == district)
    if hotels:
        out = out.where(F.col("hotel_id").isin([hotels] if isinstance(hotels, str) else list(hotels)))
    if band and not ignore_band:
        out = out.where(size_band() == band)
    if leads is not None:
        out = out.where(F.col("lead_days").isin([leads] if isinstance(leads, int) else list(leads)))
    if source:
        out = out.where(source_of() == source)
    return out


def price_heatmap(df: DataFrame, days: int = 30) -> DataFrame:
    """Hotel x stay date over the first ``days`` stay dates: median, lowest and
    highest price, distinct rooms, lead times, and the heat hue. The scale spans
    all cells, shown or not."""
    price = F.coalesce("nightly_adr_twd", "total_twd", F.col("total_price").cast("double"))
    d = df.withColumn("_price", price).where((F.col("hotel_id") != "") & F.col("check_in").isNotNull() & F.col("_price").isNotNull())
    cell = ["hotel_id", "check_in"]
    stats = grouped_stats(d, cell, {"p": "_price"})
    room = F.coalesce(F.when(F.col("room_type_name") != "", F.col("room_type_name")), F.when(F.col("room_type_code") != "", F.col("room_type_code")), F.lit("—"))
    variety = d.select(*cell, room.alias("r"), "lead_days").groupBy(*cell).agg(
        F.countDistinct("r").alias("rooms"),
        # Lead times are a handful of fixed offsets.
        F.array_join(F.transform(F.array_sort(F.collect_set("lead_days")), lambda x: x.cast("string")), ",").alias("leads"),
    )
    cells = stats.join(variety, cell)
    span = stats.agg(F.struct(F.min("p_median").alias("lo"), F.max("p_median").alias("hi")).alias("span")).scalar()
    first = d.select("check_in").distinct().orderBy("check_in").limit(days)
    low, high = F.col("_span.lo"), F.col("_span.hi")
    ratio = F.when(high == low, F.lit(0.5)).otherwise((F.col("p_median") - low) / (high - low))
    return (
        cells.withColumn("_span", span).join(first, "check_in", "left_semi")
        .select(
            *cell, F.col("p_median").alias("median"), F.col("p_min").alias("low"), F.col("p_max").alias("high"), "rooms", "leads",
            ratio.alias("ratio"),
        )
        .withColumn("hue", F.floor(F.lit(120.0) * (1 - F.col("ratio")) + 0.5).cast("int"))
    )


def stay_trend(df: DataFrame) -> DataFrame:
    return grouped_medians(df, ["hotel_id", "check_in"], {"median_twd": "nightly_adr_twd"})


def observed_trend(df: DataFrame) -> DataFrame:
    d = df.withColumn("day", F.to_date("queried_at"))
    s = grouped_stats(d, ["hotel_id", "day"], {"p": "nightly_adr_twd"})
    return s.select("hotel_id", "day", F.col("p_mean").alias("average_twd"), F.col("p_median").alias("median_twd"))


def booking_curve(df: DataFrame) -> DataFrame:
    return grouped_medians(df, ["hotel_id", "lead_days"], {"median_twd": "nightly_adr_twd"})


def room_catalog(df: DataFrame) -> DataFrame:
    """Price span per room name and size."""
    s = grouped_stats(df.where("room_type_name <> ''"), ["room_type_name", "room_size_sqm"], {"p": "nightly_adr_twd"})
    return s.select(
        "room_type_name", "room_size_sqm", F.col("p_min").alias("low"), F.col("p_median").alias("median"),
        F.col("p_max").alias("high"), F.col("p_n").alias("observations"),
    )


def room_variety(df: DataFrame) -> DataFrame:
    """Per hotel: room names against distinct areas, suite share, invalid unit
    prices (a price without a usable area)."""
    area = positive("room_size_sqm")
    return df.groupBy("hotel_id").agg(
        F.countDistinct("room_type_name").alias("room_names"),
        F.countDistinct(area).alias("area_specs"),
        F.try_divide(F.count_if(area >= 80).cast("double"), F.count("*").cast("double")).alias("suite_share"),
        F.count_if(F.col("nightly_adr_twd").isNotNull() & positive("price_per_sqm").isNull()).alias("invalid_unit_price"),
    )


def band_facets(df: DataFrame) -> DataFrame:
    """Distinct room products per size band."""
    room = F.coalesce(F.when(F.col("room_type_code") != "", F.col("room_type_code")), F.col("room_type_name"))
    product = F.concat_ws("|", "hotel_id", room, F.coalesce(F.col("room_size_sqm").cast("string"), F.lit("")))
    return df.select(size_band().alias("band"), product.alias("p")).groupBy("band").agg(F.countDistinct("p").alias("room_types"))


def place_rank(column: str, order: tuple[str, ...]) -> Column:
    """Position in the fixed order; unlisted places come after all listed ones."""
    out = F.when(F.lit(False), F.lit(0))
    for i, place in enumerate(order):
        out = out.when(F.col(column) == place, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def place_facets(df: DataFrame, column: str = "city") -> DataFrame:
    """Hotels per city or district, with the rank to list them in."""
    order = CITY_ORDER if column == "city" else DISTRICT_ORDER
    return (
        df.groupBy(column).agg(F.countDistinct("hotel_id").alias("hotels")).withColumn("rank", place_rank(column, order))
    )


def service_charge(df: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """Documented percent, else the observed median of service over base price,
    else unknown - never 0 by default."""
    base, service = positive("price_before_tax"), F.col("service_charge").try_cast("double")
    observed = grouped_medians(
        df.where(base.isNotNull() & service.isNotNull()), ["hotel_id"], {"observed_percent": service / base * 100}
    )
    hotels = df.where("hotel_id <> ''").select("hotel_id").distinct().join(observed, "hotel_id", "left")
    if documented is not None:
        hotels = hotels.join(documented.select("hotel_id", F.col("service_charge_percent").cast("double").alias("documented_percent")), "hotel_id", "left")
    else:
        hotels = hotels.withColumn("documented_percent", F.lit(None).cast("double"))
    return hotels.select(
        "hotel_id",
        F.coalesce("documented_percent", "observed_percent").alias("service_charge_percent"),
        F.when(F.col("documented_percent").isNotNull(), F.lit("documented"))
        .when(F.col("observed_percent").isNotNull(), F.lit("observed"))
        .otherwise(F.lit("unknown"))
        .alias("provenance"),
    )


def freshness(df: DataFrame, as_of: Column) -> DataFrame:
    """Hours since each hotel's last success: fresh to 36, aging to 72, else stale."""
    age = (F.unix_micros(as_of) - F.unix_micros("last_success")) / 3.6e9
    return (
        df.groupBy("hotel_id").agg(F.max("queried_at").alias("last_success"))
        .withColumn("age_hours", age)
        .withColumn("state", F.when(F.col("age_hours") <= 36, F.lit("fresh")).when(F.col("age_hours") <= 72, F.lit("aging")).otherwise(F.lit("stale")))
    )


def scheduled_fresh(fresh: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of the scheduled (enabled) hotels that are fresh."""
    s = catalog.where("enabled").select("hotel_id").join(fresh, "hotel_id", "left")
    n = s.agg(F.count_if(F.col("state") == "fresh").alias("fresh"), F.count("*").alias("scheduled"))
    return n.withColumn("ratio", F.try_divide(F.col("fresh").cast("double"), F.col("scheduled").cast("double")))


def core_share(df: DataFrame) -> DataFrame:
    """Core-room (45 up to 60 sqm) rows per hotel."""
    return df.groupBy("hotel_id").agg(F.count_if(core_room()).alias("core_rows"), F.count("*").alias("rows"))
