"""Digests of sets of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merkle(leaves: DataFrame, by: list[str], leaf: str, levels: tuple[int, ...] = (4, 2, 0)) -> DataFrame:
    """(by, digest): one digest over the hexadecimal ``leaf`` digests of a group, in any
    order. Leaves with the same first digits are one node, whose digest is that of its
    sorted leaves; nodes are joined in the same way by fewer digits, the root by none. So
    a node holds a small share of a large group."""
    d = leaves.select(*by, F.col(leaf).alias("node"), F.col(leaf).alias("digest"))
    for n in levels:
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "digest"))), "\n"), 256)
        d = d.groupBy(*by, F.substring("node", 1, n).alias("_up")).agg(joined.alias("digest")).withColumnRenamed("_up", "node")
    return d.select(*by, "digest")
