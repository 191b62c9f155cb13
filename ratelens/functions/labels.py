"""Room labels: normalisation, classes, beds, areas and stable ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratelens.functions.distinct import null_safe
from ratelens.functions.pricing import as_col, positive
from ratelens.session import cut_lineage

# Tokens of the room classes, strongest first.
ROOM_CLASS_TOKENS = (
    ("villa", ("villa", "別墅", "ヴィラ")),
    ("residence", ("residence", "公寓", "レジデンス")),
    ("suite", ("suite", "套房", "スイート")),
)

# Tokens of the bed types. The queen token is part of a king token,
# so such labels count as multiple.
BED_TOKENS = (
    ("king", ("king", "特大床", "一大床", "キング")),
    ("queen", ("queen", "大床", "クイーン")),
    ("twin", ("twin", "雙床", "兩床", "ツイン")),
    ("double", ("double", "雙人床", "ダブル")),
)


@F.pandas_udf(T.StringType())
def _fold_unicode(labels: pd.Series) -> pd.Series:
    # NFKC and case folding have no built-in counterpart in Spark.
    def fold(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum())

    return labels.map(fold, na_action="ignore")


def with_normalized_label(df: DataFrame, label: str = "room_type_name", out: str = "norm_label") -> DataFrame:
    """Add the label without case, width, punctuation and blanks; '' when absent.

    ASCII labels stay in the JVM. The others pass the Arrow UDF once per distinct
    label and are joined back, written first as in ``per_distinct``."""
    raw = F.coalesce(F.col(label), F.lit(""))
    ascii_only = raw.rlike(r"^[\x00-\x7F]*$")
    plain = F.regexp_replace(F.lower(raw), "[^0-9a-z]", "")
    wide = df.where(~ascii_only).select(label).distinct().withColumn("_folded", _fold_unicode(F.col(label)))
    return null_safe(df, cut_lineage(wide, "labels"), [label]).withColumn(out, F.coalesce("_folded", plain)).drop("_folded")


def _mentions(text: Column, tokens) -> Column:
    hit = F.lit(False)
    for t in tokens:
        hit = hit | text.contains(t)
    return hit


def _names(*names) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(as_col(n), F.lit("")) for n in names]))


def room_class(name_zh="name_zh", name_en="name_en", name_ja="name_ja") -> Column:
    text = _names(name_zh, name_en, name_ja)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, tokens in ROOM_CLASS_TOKENS:
        out = out.when(_mentions(text, tokens), F.lit(label))
    return out.otherwise(F.lit("room"))


def bed_type(name_zh="name_zh", name_en="name_en", name_ja="name_ja", aliases="aliases_zh") -> Column:
    extra = F.lower(F.concat_ws(" ", as_col(aliases)))
    text = F.concat_ws(" ", _names(name_zh, name_en, name_ja), extra)
    hits = F.filter(
        F.array(*[F.when(_mentions(text, tokens), F.lit(label)) for label, tokens in BED_TOKENS]),
        lambda x: x.isNotNull(),
    )
    return (
        F.when(F.size(hits) > 1, F.lit("multiple"))
        .when(F.size(hits) == 1, F.element_at(hits, 1))
        .otherwise(F.lit("unspecified"))
    )


def _plain_number(x: Column) -> Column:
    """Decimal text without trailing zeros: 45.0 is '45', 45.50 is '45.5'."""
    text = x.cast("decimal(28,8)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def area_spec(exact="size_sqm", low="size_sqm_min", high="size_sqm_max") -> Column:
    """struct(min, max, key): bounds with fallbacks; the key is 'a' or 'a-b'."""
    one = positive(exact)
    lo = F.coalesce(positive(low), one)
    hi = F.coalesce(positive(high), one, lo)
    key = F.when(lo == hi, _plain_number(lo)).otherwise(F.concat(_plain_number(lo), F.lit("-"), _plain_number(hi)))
    known = lo.isNotNull()
    return F.struct(
        lo.alias("size_sqm_min"), F.when(known, hi).alias("size_sqm_max"), F.when(known, key).alias("area_spec_key")
    )


def stable_room_id(hotel="hotel_id", en="name_en", zh="name_zh", ja="name_ja", area="area_spec_key") -> Column:
    """Identity of an evidenced room: a digest of hotel, names and area."""
    parts = [F.lower(F.trim(F.coalesce(as_col(c), F.lit("")))) for c in (hotel, en, zh, ja, area)]
    return F.concat(F.lit("rt_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def cjk_count(c) -> Column:
    """Number of CJK ideographs in the text."""
    text = as_col(c)
    return F.length(text) - F.length(F.regexp_replace(text, "[㐀-䶿一-鿿]", ""))
