"""Adapter health from an attempt log: totals, daily table, backoff.

Attempts: adapter, hotel_id, ts, seq (order among equal times), outcome
('success', 'empty', 'failure'), status_code, duration_ms, reason.

One adapter may own a third of the log, so nothing orders a whole pair in one task:
totals are aggregates, and running values are built from one row per pair and chunk
of time plus a window inside the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.functions.offers import safe_reason, status_from_text

PAIR = ["adapter", "hotel_id"]

# Statuses that mean the source blocks us.
BLOCKING = (403, 429)


@dataclass(frozen=True)
class BackoffPolicy:
    """Minutes of cooldown; the defaults are fixed values."""

    failure_threshold: int = 2
    base_minutes: int = 360
    blocked_base_minutes: int = 1440
    max_minutes: int = 10080


def classify(attempts: DataFrame) -> DataFrame:
    """Mark blocked attempts; a missing status is read from the message."""
    code = F.coalesce("status_code", status_from_text(F.col("reason")))
    failed = F.col("outcome") == "failure"
    return attempts.withColumns(
        {
            "status_code": code,
            "is_failure": failed,
            "is_blocked": failed & F.coalesce(code.isin(*BLOCKING), F.lit(False)),
            "ms": F.greatest(F.lit(0.0), F.col("duration_ms")),
        }
    )


def cooldown_minutes(blocked: Column, blocked_count: Column, streak: Column, policy: BackoffPolicy = BackoffPolicy()) -> Column:
    """Exponential backoff. The blocked exponent uses the lifetime count, which
    never resets; the other uses the current streak."""

    def grow(base: int, exponent: Column) -> Column:
        # Past this exponent the cap has long been reached; it keeps 2^n finite.
        return F.least(F.lit(float(policy.max_minutes)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(exponent, F.lit(40))))

    return F.when(blocked, grow(policy.blocked_base_minutes, F.greatest(blocked_count - 1, F.lit(0)))).when(
        streak >= policy.failure_threshold, grow(policy.base_minutes, streak - policy.failure_threshold)
    )


def _rates(prefix: str = "") -> dict[str, Column]:
    done = F.col("successes") + F.col("failures")
    return {
        "success_rate": F.when(done > 0, F.round(F.col("successes") / done, 4)),
        "average_response_ms": F.round(F.col("total_response_ms") / F.col("attempts"), 2),
    }


_TOTALS = lambda: [  # noqa: E731 - one shared aggregate list
    F.count("*").alias("attempts"),
    F.count_if(F.col("outcome") == "success").alias("successes"),
    F.count_if("is_failure").alias("failures"),
    F.count_if(F.col("outcome") == "empty").alias("empty_responses"),
    F.count_if("is_blocked").alias("blocked_count"),
    F.sum("ms").alias("total_response_ms"),
]


def health_state(attempts: DataFrame, policy: BackoffPolicy = BackoffPolicy()) -> DataFrame:
    """Final state per (adapter, hotel): counters, rates, streak and cooldown.

    The streak is the number of failures after the last attempt that did not fail:
    one aggregate finds that attempt, a second counts."""
    a = classify(attempts).withColumn("at", F.struct("ts", "seq"))
    resets = a.groupBy(*PAIR).agg(F.max(F.when(~F.col("is_failure"), F.col("at"))).alias("reset_at"))
    d = a.join(resets, PAIR)
    late = F.col("reset_at").isNull() | (F.col("at") > F.col("reset_at"))
    last = lambda c: F.max_by(c, "at")
    out = d.groupBy(*PAIR).agg(
        *_TOTALS(),
        F.count_if(F.col("is_failure") & late).alias("consecutive_failures"),
        F.max("ts").alias("last_attempt_at"),
        F.max(F.when(F.col("outcome") == "success", F.col("ts"))).alias("last_success_at"),
        last(F.when(F.col("is_blocked"), F.lit("blocked")).when(F.col("is_failure"), F.lit("failed")).otherwise(F.col("outcome"))).alias("last_status"),
    )
    minutes = F.when(
        F.col("last_status").isin("blocked", "failed"),
        cooldown_minutes(F.col("last_status") == "blocked", F.col("blocked_count"), F.col("consecutive_failures"), policy),
    )
    return out.withColumns(_rates()).withColumn(
        "cooldown_until", F.when(minutes.isNotNull(), F.timestamp_micros(F.unix_micros("last_attempt_at") + (minutes * 60_000_000).cast("long")))
    )


def daily_health(attempts: DataFrame) -> DataFrame:
    """The daily child table."""
    a = classify(attempts).withColumn("day", F.to_date("ts"))
    return a.groupBy(*PAIR, "day").agg(*_TOTALS()).withColumns(_rates())


def attempt_states(attempts: DataFrame, policy: BackoffPolicy = BackoffPolicy(), chunk: str = "hour") -> DataFrame:
    """The state right after every attempt: streak, blocked so far, cooldown.

    Within a chunk of time a window counts; what earlier chunks contribute is
    carried from one summary row per (pair, chunk)."""
    a = classify(attempts).withColumn("chunk", F.date_trunc(chunk, "ts"))
    order = [F.col("ts"), F.col("seq")]
    inside = Window.partitionBy(*PAIR, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct("ts", "seq")
    chunks = a.groupBy(*PAIR, "chunk").agg(
        F.count_if("is_failure").alias("fails"),
        F.count_if("is_blocked").alias("blocks"),
        F.max(F.when(~F.col("is_failure"), at)).alias("last_reset"),
    )
    tail = a.join(chunks.select(*PAIR, "chunk", "last_reset"), [*PAIR, "chunk"]).groupBy(*PAIR, "chunk").agg(
        F.count_if(F.col("is_failure") & (F.col("last_reset").isNull() | (at > F.col("last_reset")))).alias("tail_fails")
    )
    # Chunks form islands that start at a chunk with a reset in it: the streak that
    # enters a chunk is the sum of the tails since that start.
    prior = Window.partitionBy(*PAIR).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*PAIR).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    s = chunks.join(tail, [*PAIR, "chunk"]).withColumn("island", F.sum(F.col("last_reset").isNotNull().cast("int")).over(so_far))
    island = Window.partitionBy(*PAIR, "island").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("out_streak", F.sum("tail_fails").over(island)).withColumns(
        {
            "in_streak": F.coalesce(F.lag("out_streak").over(Window.partitionBy(*PAIR).orderBy("chunk")), F.lit(0)),
            "in_blocked": F.coalesce(F.sum("blocks").over(prior), F.lit(0)),
        }
    ).select(*PAIR, "chunk", "in_streak", "in_blocked")
    d = a.withColumn("seen_resets", F.sum((~F.col("is_failure")).cast("int")).over(inside))
    since = Window.partitionBy(*PAIR, "chunk", "seen_resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns(
        {
            "own_streak": F.sum(F.col("is_failure").cast("int")).over(since),
            "own_blocked": F.sum(F.col("is_blocked").cast("int")).over(inside),
        }
    ).join(s, [*PAIR, "chunk"])
    d = d.withColumns(
        {
            "consecutive_failures": F.when(F.col("seen_resets") > 0, F.col("own_streak")).otherwise(F.col("own_streak") + F.col("in_streak")),
            "blocked_count": F.col("own_blocked") + F.col("in_blocked"),
        }
    )
    minutes = F.when(
        F.col("is_failure"), cooldown_minutes(F.col("is_blocked"), F.col("blocked_count"), F.col("consecutive_failures"), policy)
    )
    return d.withColumns(
        {"cooldown_minutes": minutes, "safe_reason": safe_reason(F.col("reason"))}
    ).drop("chunk", "seen_resets", "own_streak", "own_blocked", "in_streak", "in_blocked")


# The columns that may be published.
PUBLIC_COLUMNS = (
    "adapter", "hotel_id", "attempts", "successes", "failures", "empty_responses", "blocked_count",
    "success_rate", "average_response_ms", "last_status", "last_attempt_at", "last_success_at", "cooldown_until",
)


def public_health(state: DataFrame) -> DataFrame:
    """Operational aggregates without messages or URLs."""
    return state.select(*PUBLIC_COLUMNS)
