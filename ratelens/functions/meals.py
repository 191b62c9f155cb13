"""Three-valued breakfast flag from the product's own label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.functions.cancellation import squash
from ratelens.functions.distinct import per_distinct
from ratelens.functions.pricing import as_col

# Wordings that exclude breakfast (checked first).
EXCLUDED_PATTERN = r"(?:不含|無)[^｜|]{0,12}早餐"
EXCLUDED_TERMS = (
    "不含早餐", "不含早", "不含餐食", "無早餐", "純住宿", "breakfast not included", "room only",
)
# Wordings that include breakfast.
INCLUDED_PATTERNS = (r"含[^｜|]{0,12}早餐", r"含\s*\d+\s*早")
INCLUDED_TERMS = (
    "含早餐", "含早", "早餐專案", "餐點: 早餐", "breakfast included", "with breakfast",
)


def breakfast_from_label(label="rate_plan_name") -> Column:
    """What the plan label says explicitly, else null."""
    text = squash(F.lower(F.coalesce(as_col(label), F.lit(""))))
    no = text.rlike("(?U)" + EXCLUDED_PATTERN)
    for term in EXCLUDED_TERMS:
        no = no | text.contains(term)
    yes = F.lit(False)
    for p in INCLUDED_PATTERNS:
        yes = yes | text.rlike("(?U)" + p)
    for term in INCLUDED_TERMS:
        yes = yes | text.contains(term)
    return F.when(no, F.lit(False)).when(yes, F.lit(True))


def breakfast_included(existing="breakfast_included", label="rate_plan_name") -> Column:
    """The stated flag, else what the label says, else null - never a guess."""
    return F.coalesce(as_col(existing).try_cast("boolean"), breakfast_from_label(label))


def with_breakfast(df: DataFrame, existing="breakfast_included", label="rate_plan_name") -> DataFrame:
    """Fill ``existing``, reading every distinct label once."""
    out = per_distinct(df, [label], {"_label_says": breakfast_from_label(label)})
    return out.withColumn(existing, F.coalesce(F.col(existing).try_cast("boolean"), "_label_says")).drop("_label_says")
