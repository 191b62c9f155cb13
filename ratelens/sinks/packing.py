"""Greedy packing of ordered rows into shards of a bounded size, on any number of tasks.

The first shard of a group begins with its first row, and each later one with the first
row that no longer fits into the one before. That row depends on the shard's first row
alone, so it is a successor pointer, found by a search in the prefix sums of the sizes.
Which rows begin a shard is the orbit of the first row under these pointers.

Prefix sums come from the sums of the sorted partitions. The rows of a group are cut into
blocks of ``span`` limits' worth of bytes; in a block, pointers are followed to where each
row's orbit leaves it. Only the rows in the first limit of a block can be entered from
another block, and over these jumps from block to block the orbit is found by doubling.
So a group of any size is spread over tasks, and how it is spread changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ratelens.session import cut_lineage


def _successors(start: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """For each row, which begins a shard, the number of the first row that doesn't fit."""
    return np.maximum(np.searchsorted(end, start + limit, side="right"), np.arange(1, len(start) + 1))


def _jumps(group: list[str], limit: int, width: int):
    def job(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        start, end = table.column("start").to_numpy(), table.column("end").to_numpy()
        block = table.column("block")[0].as_py()
        own = int(np.searchsorted(start, (block + 1) * width))  # the rest is the begin of the next block
        after = _successors(start, end, limit)
        # An oversized last row is followed by the row that starts at its end, if there is one.
        at = np.append(start, end[-1] if end[-1] - start[-1] > limit else -1)
        leaves, begun = np.empty(own, np.int64), np.empty(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = int(after[i])
            leaves[i], begun[i] = (leaves[j], begun[j] + 1) if j < own else (at[j] if j < len(start) or end[i] - start[i] > limit else -1, 1)
        entries = np.flatnonzero(start[:own] - block * width <= limit)
        if own and not len(entries):
            entries = np.zeros(1, np.int64)
        out = table.select([*group, "block"]).take(pa.array(entries))
        return out.append_column("entry", pa.array(start[entries])).append_column("leaves", pa.array(leaves[entries])).append_column("begun", pa.array(begun[entries]))

    return job


def _numbers(group: list[str], limit: int):
    def job(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        start, end = table.column("start").to_numpy(), table.column("end").to_numpy()
        after, first = _successors(start, end, limit), np.zeros(len(start), np.int64)
        entry, before = table.column("entry")[0].as_py(), table.column("before")[0].as_py()
        i = len(start) if entry is None else int(np.searchsorted(start, entry))
        while i < len(start):
            first[i] = 1
            i = int(after[i])
        return pa.table([table.column("at"), pa.array(before + np.cumsum(first))], ["at", "shard"])

    return job


def _orbit(jumps: DataFrame, group: list[str]) -> DataFrame:
    """(group, entry) of the entries that the first row of each group reaches."""
    reached = jumps.where("entry = 0").select(*group, "entry")
    step = cut_lineage(jumps.where("leaves >= 0").select(*group, "entry", "leaves"), "jumps")
    while True:
        further = cut_lineage(reached.join(step, [*group, "entry"]).select(*group, F.col("leaves").alias("entry")), "reached")
        if further.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(further).distinct(), "reached")
        twice = step.join(step.select(*group, F.col("entry").alias("leaves"), F.col("leaves").alias("last")), [*group, "leaves"])
        step = cut_lineage(twice.select(*group, "entry", F.col("last").alias("leaves")), "jumps")


def with_shards(rows: DataFrame, group: list[str], order: list[Column], limit: int, span: int = 64) -> DataFrame:
    """``rows`` with a column ``shard``, from 1 in each group: in ``order``, a shard takes
    rows while the sum of their ``bytes`` is at most ``limit``; a larger row is a shard of
    its own. ``order`` must not leave different rows tied, then shards depend on the rows
    alone. Group columns must not be null."""
    width = span * limit
    by = [*[F.col(c) for c in group], *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "ordered")
    sizes = placed.select(*group, "at", F.shiftright("at", 33).alias("part"), F.col("bytes").cast("long").alias("bytes"))
    parts = sizes.groupBy(*group, "part").agg(F.sum("bytes").alias("sum"))
    to_here = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "part", F.coalesce(F.sum("sum").over(to_here), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("bytes").over(inside)
    spread = sizes.join(parts, [*group, "part"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("bytes"))
    spread = spread.select(*group, "at", "start", "end", F.floor(F.col("start") / width).alias("block"))
    spread = cut_lineage(spread, "spans")

    near = (F.col("block") > 0) & (F.col("start") - F.col("block") * width <= limit)
    seen = spread.select(*group, "start", "end", F.explode(F.when(near, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))).alias("block"))
    kinds = [StructField(c, LongType()) for c in ("entry", "leaves", "begun")]
    jumps = seen.groupBy(*group, "block").applyInArrow(_jumps(group, limit, width), StructType([*seen.select(*group, "block").schema.fields, *kinds]))
    jumps = cut_lineage(jumps, "jumps")
    entered = jumps.join(_orbit(jumps, group), [*group, "entry"])
    blocks = spread.select(*group, "block").distinct().join(entered, [*group, "block"], "left")
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "block", "entry", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before"))
    numbers = spread.join(blocks, [*group, "block"]).groupBy(*group, "block").applyInArrow(_numbers(group, limit), "at long, shard long")
    return placed.join(numbers, "at").drop("at").withColumn("shard", F.col("shard").cast("int"))
