"""Run costly text rules once per distinct text instead of once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.session import cut_lineage


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null, keeping one copy of them."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def per_distinct(df: DataFrame, keys: list[str], derived: dict[str, Column]) -> DataFrame:
    """Add ``derived`` columns, which depend on ``keys`` alone.

    The distinct texts are found with a map-side combine and written, so that Spark knows
    their size before it plans the join: few texts are broadcast and the rows stay where
    they are, many are joined by shuffle with skewed texts split by AQE. Left to be found
    out while running, few texts would get their rows dealt out by text, a task for each."""
    texts = cut_lineage(df.select(*keys).distinct(), "texts")
    return null_safe(df, texts.withColumns(derived), keys)
