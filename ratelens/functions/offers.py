"""Text rules for raw offers: areas, money, currencies, plan filters, secrets.

All are column expressions for bulk jobs over a table of raw offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.pricing import as_col, half_up

# Conversion factors.
PING_TO_SQM = "3.305785"
SQFT_TO_SQM = "0.09290304"

# Accepted unit spellings of structured sizes.
SQM_UNITS = ("sqm", "square_meter", "square_meters", "m2", "m²")
SQFT_UNITS = ("sqft", "square_foot", "square_feet", "ft2", "ft²")

_NUM = r"(\d+(?:\.\d+)?)"
# Area wordings by publishing style.
AREA_PATTERNS = {
    "metric": _NUM + r"\s*(?:平方公尺|平方米)",
    "metric_or_m2": r"(?i)" + _NUM + r"\s*(?:平方公尺|平方米|m[²2])",
    "labelled": r"(?i)(?:面積|Room size)\s*[:：]?\s*" + _NUM + r"\s*(?:平方米|平方公尺|m²|sqm)",
    "m2": r"(?i)" + _NUM + r"\s*m\s*(?:2|²)",
    "sign": _NUM + r"\s*㎡",
    "any_number": _NUM,
}
PING_PATTERN = _NUM + r"\s*坪"


# Full-width digits, which these texts use like the plain ones.
FULL_WIDTH = ("０１２３４５６７８９", "0123456789")


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.translate(text, *FULL_WIDTH), "(?U)" + pattern, 1).try_cast("decimal(18,4)")


def area_from_text(text, style: str = "metric") -> Column:
    """Square metres as the text states them in the given style, else null."""
    return _first(as_col(text), AREA_PATTERNS[style])


def area_from_ping(text, scale: int = 2) -> Column:
    """Ping converted and rounded half-up to ``scale`` decimals."""
    ping = _first(as_col(text), PING_PATTERN)
    return half_up(ping * F.lit(PING_TO_SQM).cast("decimal(9,6)"), scale)


def area_from_offer(text) -> Column:
    """Metric wording first, then ping."""
    return F.coalesce(area_from_text(text).cast("decimal(28,10)"), area_from_ping(text).cast("decimal(28,10)"))


def area_from_unit(value, unit) -> Column:
    """A number with a labelled unit; an unlabelled or unfamiliar one is unknown."""
    v = as_col(value).try_cast("decimal(18,4)")
    u = F.regexp_replace(F.lower(F.trim(F.coalesce(as_col(unit), F.lit("")))), "-", "_")
    feet = half_up(v * F.lit(SQFT_TO_SQM).cast("decimal(10,8)"), 2).cast("decimal(28,10)")
    return F.when(v > 0, F.when(u.isin(*SQM_UNITS), v.cast("decimal(28,10)")).when(u.isin(*SQFT_UNITS), feet))


def money_from_text(text) -> Column:
    """Digits, sign and point of a price text; null when nothing is left."""
    return F.regexp_replace(as_col(text), r"[^0-9.\-]", "").try_cast("decimal(18,4)")


def currency_from_text(text) -> Column:
    """Currency by code, else by symbol; null when neither is shown."""
    t = F.upper(F.regexp_replace(F.coalesce(as_col(text), F.lit("")), " ", " "))
    code = F.regexp_extract(t, r"\b(NTD|TWD|USD|JPY)\b", 1)
    packed = F.regexp_replace(t, r"(?U)\s+", "")
    return (
        F.when(code == "NTD", F.lit("TWD"))
        .when(code != "", code)
        .when(packed.contains("NT$"), F.lit("TWD"))
        .when(packed.contains("US$"), F.lit("USD"))
        .when(packed.contains("JP¥") | packed.contains("JPY¥"), F.lit("JPY"))
        .when(packed.contains("$"), F.lit("USD"))
        .when(packed.contains("¥"), F.lit("JPY"))
    )


# Fixed value: below this an unlabelled total can only be USD, from it on only TWD.
MAGNITUDE_SPLIT = 3000


def resolve_currency(text, total) -> Column:
    amount = as_col(total)
    return F.coalesce(
        currency_from_text(text),
        F.when((amount > 0) & (amount < MAGNITUDE_SPLIT), F.lit("USD")).when(amount >= MAGNITUDE_SPLIT, F.lit("TWD")),
    )


# Wordings of plans that are not open to the public.
EXCLUDED_PLAN_TERMS = {
    "luxury": ("fans of m.o.", "member", "travel advisor", "rack rate"),
    "mileage": ("member price", "rack rate", "airlines ffp"),
}

# The baseline plan that single properties are reduced to.
# (hotel, how the plan must relate to the text, the text, blanks ignored)
PROPERTY_PLAN_RULES = (
    ("grand_hilai_taipei", "prefix", "一般訂房", False),
    ("grand_hotel_taipei", "contains", "【圓山假期】", False),
    ("hotel_royal_hsinchu", "prefix", "國人住房專案", True),
)


def public_plan(plan, style: str = "luxury") -> Column:
    text = F.lower(F.coalesce(as_col(plan), F.lit("")))
    bad = F.lit(False)
    for term in EXCLUDED_PLAN_TERMS[style]:
        bad = bad | text.contains(term)
    return ~bad


def is_public_cash(member_rate) -> Column:
    """A plan with a signed-in member price attached is not a public one."""
    return F.trim(F.coalesce(as_col(member_rate), F.lit(""))) == ""


def baseline_plans(df: DataFrame, rules: DataFrame, plan: str = "rate_plan_name") -> DataFrame:
    """Keep every plan of a hotel without a rule, and the plans that match one.

    ``rules``: hotel_id, how ('prefix' or 'contains'), text, squeeze."""
    r = rules.select(F.col("hotel_id").alias("_h"), "how", "text", "squeeze")
    name = F.when(F.col("squeeze"), F.regexp_replace(F.col(plan), " ", "")).otherwise(F.col(plan))
    fits = F.when(F.col("how") == "prefix", name.startswith(F.col("text"))).otherwise(name.contains(F.col("text")))
    return (
        df.join(r, F.col("hotel_id") == F.col("_h"), "left")
        .where(F.col("_h").isNull() | fits)
        .drop("_h", "how", "text", "squeeze")
    )


# What a diagnostic text must never carry.
SECRET_PARAMETER = r"(?i)([?&](?:token|key|api_key|authorization|signature)=)[^&\s]+"
SECRET_HEADER = r"(?i)(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]+"
STATUS_IN_TEXT = r"(?i)(?:HTTP|status(?: code)?)\s*[:=]?\s*(\d{3})"
REASON_LIMIT = 500


def safe_reason(text) -> Column:
    """Diagnostic text on one line, without credentials, cut to its field width."""
    t = F.trim(F.regexp_replace(as_col(text), r"(?U)\s+", " "))
    t = F.regexp_replace(t, SECRET_PARAMETER, "$1[redacted]")
    t = F.regexp_replace(t, SECRET_HEADER, "[redacted authorization]")
    return F.substring(t, 1, REASON_LIMIT)


def status_from_text(text) -> Column:
    return F.regexp_extract(as_col(text), STATUS_IN_TEXT, 1).try_cast("int")
