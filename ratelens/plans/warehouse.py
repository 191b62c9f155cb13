"""Warehouse job: verified mirror, then its quality profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.operators import quality
from ratelens.operators.parity import with_comparison, with_terms
from ratelens.session import cut_lineage
from ratelens.sinks.mirror import build_mirror, current_manifest, read_mirror, update_mirror


def build(source: DataFrame, root: str) -> str:
    return build_mirror(source, root)


def update(spark: SparkSession, history: str, root: str) -> dict[str, str]:
    """Bring the mirror of a JSON history up to date; only changed months are read."""
    return update_mirror(spark, history, root)


def profile(spark: SparkSession, root: str, reviews: DataFrame | None = None) -> dict[str, DataFrame]:
    """Quality tables of the published mirror. Fails when the mirror does not hold
    the rows that its manifest states."""
    rows = read_mirror(spark, root)
    quality.assert_manifest(rows, current_manifest(spark, root))
    keyed = with_comparison(cut_lineage(with_terms(rows), "profile-terms"))
    per_grain = quality.completeness(keyed)
    gaps, latest = quality.metadata_gaps(keyed), quality.latest_metadata_gaps(keyed)
    tables = {
        "completeness": per_grain,
        "terms_coverage": quality.terms_coverage(keyed),
        "readiness": quality.readiness(keyed),
        "missing_fields": quality.missing_field_counts(keyed, ["source_platform"]),
        "metadata_gaps": gaps,
        "latest_metadata_gaps": latest,
        "unknown_policies": quality.unknown_policies(keyed),
        "blockers": quality.blocker_counts(keyed),
        "schedules": quality.structured_schedules(keyed),
        "top_tax_gaps": quality.top_tax_gaps(per_grain),
        "top_metadata_gaps": quality.ranked(gaps, "hotel_id", "source_platform", limit=25),
    }
    if reviews is not None:
        tables["review_outcome"] = quality.review_outcome(gaps, reviews)
        tables["reviewed_gaps"] = quality.reviewed_gaps(gaps, latest, reviews)
        tables["stale_reviews"] = quality.stale_reviews(reviews, gaps, latest)
    return tables
