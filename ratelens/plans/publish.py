"""Publish job: history and snapshots in, published tables out.

Rows are enriched once and written to the shared folder; every published table reads
that copy. Nothing here collects rows: the gates read counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ratelens.functions.meals import with_breakfast
from ratelens.functions.pricing import priced, publishable
from ratelens.operators import facets, health, market, matchquality, quality, rooms
from ratelens.operators.dedup import deduplicate, latest_batches
from ratelens.operators.parity import rate_parity, with_comparison, with_terms
from ratelens.session import cut_lineage
from ratelens.sinks.publish import GROUP, bounded_shards, checked_ids, dashboard_rows, file_index, heatmap_rows, partition_index, write_details, write_shards
from ratelens.sources.observations import with_source
from ratelens.sources.snapshots import validate_snapshots


@dataclass
class Published:
    """The tables of one publication; ``rows`` is the enriched history."""

    rows: DataFrame
    latest: DataFrame
    tables: dict[str, DataFrame]


def enrich(history: DataFrame, profiles: DataFrame, snapshots: DataFrame | None = None, name: str = "enriched") -> DataFrame:
    """Publishable rows, newest per natural key, with prices, meals, room and key.

    Rooms are matched before the source is backfilled: a row that never named its
    source must not match by a source's code."""
    rows = history
    if snapshots is not None:
        accepted, _ = validate_snapshots(with_terms(snapshots), strict=True)
        rows = rows.unionByName(accepted.select(*[c for c in accepted.columns if c in rows.columns]), allowMissingColumns=True)
    d = deduplicate(priced(rows).where(publishable()))
    # The prices are columns from here on and the copy is read by match and terms.
    d = cut_lineage(d, f"{name}-deduplicated")
    d = rooms.match_rooms(d, rooms.room_dimension(profiles))
    d = with_comparison(with_terms(with_breakfast(with_source(d))), require_stable_room=True)
    return cut_lineage(d, name)


def publish(
    history: DataFrame, profiles: DataFrame, snapshots: DataFrame | None = None, reviews: DataFrame | None = None,
    attempts: DataFrame | None = None, name: str = "enriched",
) -> Published:
    """Gate the room evidence, enrich, and derive every published table (lazily)."""
    rooms.assert_room_integrity(profiles)
    rows = enrich(history, profiles, snapshots, name)
    latest = latest_batches(rows)
    graded = matchquality.with_gap_category(rows)
    candidates = matchquality.unresolved_candidates(graded)
    tables = {
        "market_summary": market.market_summary(rows),
        "weekly_digest": market.weekly_digest(rows),
        "weekly_movers": market.weekly_movers(rows),
        "lead_time_curve": market.lead_time_curve(rows),
        "daily_digest": market.daily_digest(rows, rows),
        "history_rollups": market.history_rollups(rows),
        "warnings": quality.volume_warnings(rows),
        "rate_parity": rate_parity(rows),
        "latest_summary": market.latest_summary(latest, rows),
        "latest_heatmap_rows": heatmap_rows(latest),
        "heatmap": facets.price_heatmap(latest),
        "partition_index": partition_index(rows),
        "match_overview": matchquality.match_overview(graded),
        "match_counts": matchquality.count_maps(graded),
        "top_candidates": matchquality.top_candidates(candidates),
        "strict_gap_hotels": matchquality.strict_gap_hotels(graded),
        "room_dimension": rooms.room_dimension(profiles),
    }
    if reviews is not None:
        tables["reviewed_candidates"] = matchquality.reviewed_candidates(candidates, reviews).where("review_status is not null")
        tables["stale_room_reviews"] = matchquality.stale_room_reviews(candidates, reviews)
        tables["mapping_priority"] = matchquality.mapping_priority(candidates, reviews)
    if attempts is not None:
        tables["adapter_health"] = health.public_health(health.health_state(attempts))
    return Published(rows, latest, tables)


def write_published(p: Published, root: str, max_shard_bytes: int | None = None) -> DataFrame:
    """Write the tables, the detail partitions and the bounded shards; return the
    shard index. Both indexes list the files that were written."""
    spark = p.rows.sparkSession
    for name, df in p.tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")
    rows = dashboard_rows(checked_ids(p.rows)).withColumn("observation_id", F.xxhash64("*").cast("string"))
    write_details(rows.drop("observation_id"), f"{root}/rates")
    file_index(spark, root, "rates", GROUP[:2]).write.mode("overwrite").json(f"{root}/rates_index")
    shards = bounded_shards(rows, max_shard_bytes) if max_shard_bytes else bounded_shards(rows)
    write_shards(shards, f"{root}/shards")
    index = file_index(spark, root, "shards", [*GROUP, "shard"])
    index.write.mode("overwrite").json(f"{root}/shard_index")
    return index
