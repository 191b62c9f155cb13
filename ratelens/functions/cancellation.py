"""Cancellation terms: class, comparable deadline, penalty schedule, blocker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.distinct import per_distinct
from ratelens.functions.pricing import as_col, as_date
from ratelens.schema import UNKNOWN

# English number words that state a number of days.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fourteen": 14,
    "fifteen": 15, "twenty": 20, "thirty": 30,
}
_WORDS = "|".join(NUMBER_WORDS)

# Wordings that deny any refund.
NON_REFUNDABLE_TERMS = (
    "non-refundable", "non refundable", "不可退款", "不得退款", "不得取消", "取消不可",
    "取消須付費（訂單總額）", "取消須付費 (訂單總額)", "100% of stay room charge",
    "無法退款", "返金不可", "キャンセル不可",
)

# Wordings that promise free cancellation.
FREE_TERMS = (
    "free cancellation", "free cancel", "免費取消", "可免費取消", "無料キャンセル", "キャンセル無料",
)

# Patterns that state a deadline (any of them makes it conditional).
DEADLINE_PATTERNS = (
    r"(?:before|prior to|抵達前|入住前|日前|日まで).{0,30}\d+",
    r"\d+.{0,30}(?:before|prior to|日前|日まで)",
    r"(?:入住|抵達)\s*\d+\s*(?:天|日)前",
    r"(?:預定)?住宿日前第[一二三四五六七八九十]+日以前",
    r"\d{4}\s*[年/-]\s*\d{1,2}\s*[月/-]\s*\d{1,2}\s*日前",
    r"cancelled\s+after.{0,80}\d{1,2}\s+[a-z]{3,9}\s+20\d{2}",
    rf"(?:{_WORDS})\s+days?\s+prior to\s+(?:arrival|check[- ]?in)",
    r"day prior to arrival",
)

# Dated deadlines.
FULL_DATE = r"(20\d{2})\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})"
MONTH_DAY = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日"
ENGLISH_DATE = r"(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(20\d{2})"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Relative deadlines, in order of precedence.
RELATIVE_DAYS = (
    r"入住日前至少\s*(\d+)\s*(?:天|日)",
    r"入住前至少\s*(\d+)\s*(?:天|日)",
    r"入住\s*(\d+)\s*(?:天|日)前",
    r"抵達前\s*(\d+)\s*(?:天|日)",
    r"抵達前.{0,40}?\d{1,2}:\d{2}\s*(\d+)\s*(?:天|日)",
    r"(\d+)\s*(?:\(\d+\))?\s*days?\s+prior to\s+(?:arrival|check[- ]?in)",
)
WORD_DAYS = rf"({_WORDS})\s+(?:\(\d+\)\s*)?days?\s+prior to\s+(?:arrival|check[- ]?in)"
DAY_PRIOR = r"(?:the|one) day prior to arrival"
CJK_DAYS = r"(?:預定)?住宿日前第([一二三四五六七八九十]+)日以前"
CJK_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

# Tiers of a penalty schedule.
TIER = r"(\d+)\s*[~～-]\s*(\d+)\s*(?:天|日)(?:之前|前).{0,30}?訂金(?:的)?\s*(\d+)\s*[％%]"
SAME_DAY_TIER = r"當天.{0,30}?訂金(?:的)?\s*(\d+)\s*[％%]"
TIER_TYPE = "struct<days_before_from:int,days_before_to:int,penalty_percent:int,penalty_basis:string>"

# Texts that can never be normalised.
PLACEHOLDER_TEXT = "cancellation policy is available on the official booking page"
FEE_NOTICE_TEXT = "將收取取消費用"

# Java's classes are ASCII unless told otherwise.
_U = "(?U)"


def squash(c) -> Column:
    """Collapse runs of white space to one blank, trim, and make full-width digits and
    percent signs plain, as the number casts read plain ones only."""
    return F.trim(F.regexp_replace(F.translate(as_col(c), "０１２３４５６７８９％", "0123456789%"), _U + r"\s+", " "))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_U + pattern)


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, _U + pattern, group)


def _contains_any(text: Column, terms) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def cancellation_schedule(policy="cancellation_policy") -> Column:
    """Explicit multi-stage penalties; empty unless at least two sane tiers."""
    text = squash(policy)
    nums = [F.regexp_extract_all(text, F.lit(_U + TIER), F.lit(i)) for i in (1, 2, 3)]
    ranged = F.transform(
        F.arrays_zip(*[n.alias(a) for n, a in zip(nums, ("f", "t", "p"))]),
        lambda x: F.struct(
            x["f"].try_cast("int").alias("days_before_from"),
            x["t"].try_cast("int").alias("days_before_to"),
            x["p"].try_cast("int").alias("penalty_percent"),
            F.lit("deposit").alias("penalty_basis"),
        ),
    )
    same_pct = _group(text, SAME_DAY_TIER).try_cast("int")
    same = F.when(
        _has(text, SAME_DAY_TIER),
        F.array(
            F.struct(
                F.lit(0).alias("days_before_from"),
                F.lit(0).alias("days_before_to"),
                same_pct.alias("penalty_percent"),
                F.lit("deposit").alias("penalty_basis"),
            )
        ),
    ).otherwise(F.array().cast(f"array<{TIER_TYPE}>"))
    tiers = F.concat(ranged, same)
    sane = F.forall(
        tiers,
        lambda x: F.coalesce(
            (x["days_before_from"] >= x["days_before_to"]) & x["penalty_percent"].between(0, 100),
            F.lit(False),
        ),
    )
    none = F.array().cast(f"array<{TIER_TYPE}>")
    return F.when((F.size(tiers) >= 2) & sane, tiers).otherwise(none)


def cancellation_class(policy="cancellation_policy") -> Column:
    """conditional / non_refundable / free_cancellation / unknown.

    A schedule wins; a denial of refunds beats a deadline; and 'free until a
    deadline' is conditional, never unrestricted."""
    raw = as_col(policy)
    text = squash(F.lower(raw))
    deadline = F.lit(False)
    for p in DEADLINE_PATTERNS:
        deadline = deadline | _has(text, p)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(UNKNOWN))
        .when(F.size(cancellation_schedule(raw)) > 0, F.lit("conditional"))
        .when(_contains_any(text, NON_REFUNDABLE_TERMS), F.lit("non_refundable"))
        .when(deadline, F.lit("conditional"))
        .when(_contains_any(text, FREE_TERMS), F.lit("free_cancellation"))
        .otherwise(F.lit(UNKNOWN))
    )


def cjk_integer(c) -> Column:
    """Small CJK numerals (1 to 99) as written in published terms."""
    text = as_col(c)
    tens, ones = F.substring_index(text, "十", 1), F.substr(text, F.instr(text, "十") + 1)
    compound = F.when(tens == "", F.lit(1)).otherwise(F.coalesce(_lookup(CJK_DIGITS, tens), F.lit(1))) * 10 + F.when(
        ones == "", F.lit(0)
    ).otherwise(F.coalesce(_lookup(CJK_DIGITS, ones), F.lit(0)))
    return F.when(text.contains("十"), compound).otherwise(_lookup(CJK_DIGITS, text))


def _ymd(y, m, d) -> Column:
    # A cast never throws under try_: 30 February is null, as is day 0.
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _text_or_unknown(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(UNKNOWN))


def deadline_parts(policy="cancellation_policy", text: Column | None = None) -> Column:
    """Everything a policy text says about its deadline, independent of the stay.
    Each wording keeps whether it matched apart from its (possibly invalid) value,
    because the first wording that matches decides, valid or not."""
    t = text if text is not None else squash(F.lower(as_col(policy)))
    mon_no = _lookup({m: str(i) for i, m in enumerate(MONTHS, 1)}, _group(t, ENGLISH_DATE, 2))
    days = F.coalesce(
        *[_group(t, p).try_cast("int") for p in RELATIVE_DAYS],
        _lookup(NUMBER_WORDS, _group(t, WORD_DAYS)),
        F.when(_has(t, DAY_PRIOR), F.lit(1)),
        cjk_integer(_group(t, CJK_DAYS)),
    )
    return F.struct(
        _has(t, FULL_DATE).alias("has_full"),
        _ymd(*(_group(t, FULL_DATE, i) for i in (1, 2, 3))).alias("full"),
        _has(t, MONTH_DAY).alias("has_month_day"),
        _group(t, MONTH_DAY, 1).alias("month"),
        _group(t, MONTH_DAY, 2).alias("day"),
        _has(t, ENGLISH_DATE).alias("has_english"),
        _ymd(_group(t, ENGLISH_DATE, 3), mon_no, _group(t, ENGLISH_DATE, 1)).alias("english"),
        days.alias("days"),
    )


def resolve_deadline(cls: Column, parts: Column, check_in="check_in") -> Column:
    """Anchor the parts to a stay: month and day mean the latest such date not
    after check-in, a number of days counts back from check-in."""
    stay = as_date(check_in)
    this_year = _ymd(F.year(stay).cast("string"), parts["month"], parts["day"])
    last_year = _ymd((F.year(stay) - 1).cast("string"), parts["month"], parts["day"])
    anchored = F.when(this_year > stay, last_year).otherwise(this_year)
    relative = F.when(parts["days"] > 0, F.date_sub(stay, parts["days"]))
    return (
        F.when(cls == "non_refundable", F.lit("non_refundable"))
        .when(cls == "free_cancellation", F.lit("unrestricted"))
        .when(cls != "conditional", F.lit(UNKNOWN))
        .when(parts["has_full"], _text_or_unknown(parts["full"]))
        .when(parts["has_month_day"] & stay.isNotNull(), _text_or_unknown(anchored))
        .when(parts["has_english"], _text_or_unknown(parts["english"]))
        .otherwise(_text_or_unknown(relative))
    )


def cancellation_deadline(policy="cancellation_policy", check_in="check_in") -> Column:
    """The comparable refund deadline: a date, 'unrestricted', 'non_refundable' or
    'unknown'."""
    return resolve_deadline(cancellation_class(policy), deadline_parts(policy), check_in)


def with_policy_terms(df: DataFrame, policy="cancellation_policy", check_in="check_in", schedule: bool = False) -> DataFrame:
    """Add ``cancellation_class`` and ``cancellation_deadline`` (and the schedule).

    Policy texts repeat endlessly, so the patterns run once per distinct text and
    only the anchoring to check-in runs per row."""
    derived = {
        "cancellation_class": cancellation_class(policy),
        "_parts": deadline_parts(policy),
    }
    if schedule:
        derived["cancellation_schedule"] = cancellation_schedule(policy)
    out = per_distinct(df.drop(*[c for c in derived if c in df.columns]), [policy], derived)
    return out.withColumn(
        "cancellation_deadline", resolve_deadline(F.col("cancellation_class"), F.col("_parts"), check_in)
    ).drop("_parts")


def cancellation_blocker(policy="cancellation_policy") -> Column:
    """Why a non-empty policy cannot be normalised."""
    text = F.trim(F.coalesce(as_col(policy), F.lit("")))
    return (
        F.when(text.contains("�"), F.lit("encoding_corruption"))
        .when(F.lower(text) == PLACEHOLDER_TEXT, F.lit("generic_placeholder"))
        .when(text == FEE_NOTICE_TEXT, F.lit("generic_fee_notice"))
        .otherwise(F.lit("unparsed_policy"))
    )
