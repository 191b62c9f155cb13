"""Collection job: what to request, and what came back.

Requesting itself is left to an external collector; it reads the request table and
drops files that ``streaming.ingest`` picks up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ratelens.operators import health, planning
from ratelens.sinks.history import append_observations


def requests(hotels: DataFrame, attempts: DataFrame, lead_days: str, started_at: Column, run_id: Column) -> tuple[DataFrame, DataFrame]:
    """(requests, failures), with pairs that are cooling down left out."""
    return planning.collection_plan(hotels, planning.parse_lead_days(lead_days), started_at, run_id, health.health_state(attempts))


def store(observations: DataFrame, hotels: DataFrame, path: str, started_at: Column, run_id: Column) -> int:
    """Stamp what was collected and append it; returns the rows written."""
    return append_observations(planning.restamp(observations, hotels, run_id, started_at), path)
