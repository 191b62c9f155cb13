import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ratelens.functions.pricing import priced  # noqa: E402
from ratelens.schema import conform  # noqa: E402
from ratelens.session import build_session  # noqa: E402
from ratelens.sources.observations import RAW_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


BASE = {
    "observation_id": "o1", "hotel_id": "h1", "hotel_name": "Hotel One", "city": "Taipei", "queried_at": "2026-10-08T01:00:00Z",
    "check_in": "2026-12-01", "check_out": "2026-12-02", "rooms": 1, "adults": 2, "children": 0, "room_type_code": "R1",
    "room_type_name": "Deluxe", "room_size_sqm": 50, "rate_plan_code": "P1", "rate_plan_name": "Plan", "breakfast_included": True,
    "cancellation_policy": "Free cancellation", "tax_inclusion": "included", "total_price": 10000, "currency": "TWD",
    "source_platform": "official", "status": "live", "lead_days": 7,
}


@pytest.fixture(scope="session")
def make(spark):
    """Observations from dictionaries: what is not given comes from BASE, and None
    means absent. Every value passes the reader's own text-and-cast path."""

    def build(*rows, bare=False, price=False):
        text = []
        for i, row in enumerate(rows):
            full = dict(row) if bare else {**BASE, "observation_id": f"o{i}", **row}
            text.append(tuple(None if full.get(f) is None else str(full[f]).lower() if isinstance(full[f], bool) else str(full[f]) for f in RAW_SCHEMA.names))
        df = conform(spark.createDataFrame(text, RAW_SCHEMA))
        return priced(df) if price else df

    return build
