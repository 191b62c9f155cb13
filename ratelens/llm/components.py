"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratelens.session import cut_lineage


def _star(both: DataFrame, name: str) -> DataFrame:
    """Each neighbour of a node, with the smallest of the node and its neighbours. The
    minima are a table of their own, so that the join can split a node with many links."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(cut_lineage(least, name), "u")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b), two columns of longs:
    the smallest node that can be reached. The number of rounds grows with the logarithm
    of the number of nodes; each ends with a table in the shared folder. Links may
    repeat, run either way and link a node to itself; null ends are ignored."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct()
    links, before = cut_lineage(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        links = cut_lineage(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
