"""Exact medians over a stream, as state that grows with the different values only.

The state of a (hotel, window) is a count for each value, kept in buckets of the value
with a short table of how many values each bucket holds. A micro-batch opens the buckets
it adds to and the one or two that hold the middle, whatever the window has seen before.
Values are counted in the task that reads them, so a hotel with a third of all rows sends
each of its different values once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ratelens.functions.pricing import verified_market
from ratelens.operators.stats import RESOLUTION

OUTPUT = "hotel_id string, window_start timestamp, observations long, median_twd double"


def buckets(v: np.ndarray) -> np.ndarray:
    return np.floor(np.sign(v) * np.log1p(np.abs(v)) * RESOLUTION).astype(np.int64)


def add_up(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of their counts."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


class MedianProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "bucket long", "v array<double>, n array<long>")
        self.sizes = handle.getValueState("sizes", "bucket array<long>, n array<long>")

    def _bucket(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.values.containsKey((b,)):
            return np.zeros(0), np.zeros(0, np.int64)
        v, n = self.values.getValue((b,))
        return np.array(v, float), np.array(n, np.int64)

    def _ranked(self, ids: np.ndarray, sizes: np.ndarray, rank: int) -> float:
        upto = np.cumsum(sizes)
        i = int(np.searchsorted(upto, rank))
        v, n = self._bucket(int(ids[i]))
        return float(v[np.searchsorted(np.cumsum(n), rank - (upto[i] - sizes[i]))])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [add_up(pdf["v"].to_numpy(float), pdf["n"].to_numpy()) for pdf in rows]
        v, n = add_up(*(np.concatenate(x) for x in zip(*new, strict=True)))
        of = buckets(v)
        for b in np.unique(of):
            old_v, old_n = self._bucket(int(b))
            here = of == b
            all_v, all_n = add_up(np.append(old_v, v[here]), np.append(old_n, n[here]))
            self.values.updateValue((int(b),), (all_v.tolist(), all_n.tolist()))
        ids, sizes = self.sizes.get() if self.sizes.exists() else ([], [])
        ids, sizes = add_up(np.append(np.array(ids, np.int64), of), np.append(np.array(sizes, np.int64), n))
        self.sizes.update((ids.tolist(), sizes.tolist()))
        total = int(sizes.sum())
        median = (self._ranked(ids, sizes, (total + 1) // 2) + self._ranked(ids, sizes, total // 2 + 1)) / 2
        start = pd.Timestamp(key[1])
        # Rows of a window that the watermark has passed no longer come: its state can go.
        self.handle.registerTimer(int(start.timestamp() * 1000) + 1)
        yield pd.DataFrame({"hotel_id": [key[0]], "window_start": [start], "observations": [total], "median_twd": [median]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.sizes.clear()
        yield pd.DataFrame({"hotel_id": [], "window_start": pd.to_datetime([]), "observations": [], "median_twd": []})

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.groupby(["hotel_id", "window_start", "v"], as_index=False).agg(n=("v", "size"))


def median_stream(priced: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(hotel_id, window_start, observations, median_twd) of every window that a
    micro-batch adds official prices to, exact over all rows so far. Update mode; needs
    the RocksDB state store. Windows that start more than ``late`` before the newest one
    are closed: rows that come later for them are left out, as any watermark does."""
    rows = priced.where(verified_market() & (F.col("hotel_id") != "") & (F.col("nightly_adr_twd") > 0))
    rows = rows.select("hotel_id", F.window("queried_at", length)["start"].alias("window_start"), F.col("nightly_adr_twd").cast("double").alias("v"))
    counted = rows.mapInPandas(_counted, "hotel_id string, window_start timestamp, v double, n long")
    return counted.withWatermark("window_start", late).groupBy("hotel_id", "window_start").transformWithStateInPandas(
        statefulProcessor=MedianProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )
