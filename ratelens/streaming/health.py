"""Adapter health as keyed state of a stream: the twin of ``operators.health``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ratelens.operators.health import BackoffPolicy, PAIR, classify

_STATE = (
    "attempts long, successes long, failures long, empty_responses long, blocked_count long, "
    "consecutive_failures long, total_response_ms double, last_success_at timestamp"
)
OUTPUT = (
    "adapter string, hotel_id string, attempts long, successes long, failures long, empty_responses long, "
    "blocked_count long, consecutive_failures long, total_response_ms double, last_attempt_at timestamp, "
    "last_success_at timestamp, last_status string, cooldown_until timestamp"
)


_SUMMARY = (
    "adapter string, hotel_id string, chunk long, attempts long, successes long, failures long, empty_responses long, blocked_count long, "
    "trailing_failures long, has_reset boolean, total_response_ms double, last_success_at timestamp, last_at timestamp, last_seq long, "
    "last_failed boolean, last_blocked boolean, last_outcome string"
)


def summaries(a: pd.DataFrame) -> pd.DataFrame:
    """One row for the attempts of each (pair, chunk): what it adds to the counters, the
    failures after its last attempt that did not fail (all, if there is none), whether
    there is one, and its newest attempt. Summaries of consecutive chunks add up to that
    of both, so the order inside a chunk matters here only."""
    a = a.sort_values([*PAIR, "chunk", "ts", "seq"], kind="stable")
    calm = ~a["is_failure"]
    resets_to_here = calm.groupby([a[c] for c in (*PAIR, "chunk")], dropna=False, sort=False).cumsum()
    resets = calm.groupby([a[c] for c in (*PAIR, "chunk")], dropna=False, sort=False).transform("sum")
    a = a.assign(
        ok=a["outcome"] == "success", empty=a["outcome"] == "empty", trailing=a["is_failure"] & (resets_to_here == resets), calm=calm,
        ok_at=a["ts"].where(a["outcome"] == "success"),
    )
    by = a.groupby([*PAIR, "chunk"], dropna=False, sort=False)
    return by.agg(
        attempts=("seq", "size"), successes=("ok", "sum"), failures=("is_failure", "sum"), empty_responses=("empty", "sum"), blocked_count=("is_blocked", "sum"),
        trailing_failures=("trailing", "sum"), has_reset=("calm", "any"), total_response_ms=("ms", "sum"), last_success_at=("ok_at", "max"),
        last_at=("ts", lambda x: x.iloc[-1]), last_seq=("seq", lambda x: x.iloc[-1]), last_failed=("is_failure", lambda x: x.iloc[-1]), last_blocked=("is_blocked", lambda x: x.iloc[-1]),
        last_outcome=("outcome", lambda x: x.iloc[-1]),
    ).reset_index()


def _summarised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [pdf for pdf in batches if len(pdf)]  # this task's chunks of one micro-batch
    if held:
        yield summaries(pd.concat(held, ignore_index=True))


class HealthProcessor(StatefulProcessor):
    """Folds the chunk summaries of one (adapter, hotel) in order and emits its state
    once per micro-batch. The state is eight numbers, whatever the length of the log."""

    def __init__(self, policy: BackoffPolicy = BackoffPolicy()):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", _STATE)

    def _cooldown(self, blocked: bool, blocked_count: int, streak: int) -> float | None:
        p = self.policy
        if blocked:
            return min(p.max_minutes, p.blocked_base_minutes * 2.0 ** min(max(blocked_count - 1, 0), 40))
        if streak >= p.failure_threshold:
            return min(p.max_minutes, p.base_minutes * 2.0 ** min(streak - p.failure_threshold, 40))
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows), ignore_index=True).sort_values("chunk")
        n, ok, bad, empty, blocked_n, streak, ms, last_ok = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, 0, 0.0, None)
        for c in chunks.itertuples():
            n, ok, bad, empty, blocked_n = n + int(c.attempts), ok + int(c.successes), bad + int(c.failures), empty + int(c.empty_responses), blocked_n + int(c.blocked_count)
            streak = int(c.trailing_failures) + (0 if c.has_reset else streak)
            ms += float(c.total_response_ms)
            if not pd.isna(c.last_success_at):
                top = c.last_success_at.to_pydatetime()
                last_ok = top if last_ok is None else max(last_ok, top)
        newest = chunks.iloc[-1]
        at, failed, blocked = newest["last_at"], bool(newest["last_failed"]), bool(newest["last_blocked"])
        status = "blocked" if blocked else "failed" if failed else str(newest["last_outcome"])
        wait = self._cooldown(blocked, blocked_n, streak) if failed else None
        self.state.update((n, ok, bad, empty, blocked_n, streak, ms, last_ok))
        yield pd.DataFrame(
            {
                "adapter": [key[0]], "hotel_id": [key[1]], "attempts": [n], "successes": [ok], "failures": [bad],
                "empty_responses": [empty], "blocked_count": [blocked_n], "consecutive_failures": [streak],
                "total_response_ms": [ms], "last_attempt_at": [at], "last_success_at": [pd.Timestamp(last_ok) if last_ok else pd.NaT],
                "last_status": [status], "cooldown_until": [at + pd.Timedelta(minutes=wait) if wait is not None else pd.NaT],
            }
        )

    def close(self) -> None:
        pass


def health_stream(attempts: DataFrame, policy: BackoffPolicy = BackoffPolicy(), chunk_seconds: int = 3600) -> DataFrame:
    """Updated state of every pair seen in a micro-batch. Needs the RocksDB state
    store provider. Attempts must reach the stream in time order across batches.

    Attempts are dealt by (pair, chunk of time) and summarised there, so the busiest pair
    is many tasks; its state sees one row for each chunk."""
    d = classify(attempts).select(*PAIR, F.floor(F.unix_seconds("ts") / chunk_seconds).alias("chunk"), "ts", "seq", "outcome", "is_failure", "is_blocked", "ms")
    chunks = d.repartition(*PAIR, "chunk").mapInPandas(_summarised, _SUMMARY)
    return chunks.groupBy(*PAIR).transformWithStateInPandas(
        statefulProcessor=HealthProcessor(policy), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )


def daily_health_stream(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily counters per pair as tumbling windows."""
    return (
        classify(attempts)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), *PAIR)
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(F.col("outcome") == "success").alias("successes"),
            F.count_if("is_failure").alias("failures"),
            F.count_if("is_blocked").alias("blocked_count"),
        )
        .select(*PAIR, F.to_date("window.start").alias("day"), "attempts", "successes", "failures", "blocked_count")
    )
