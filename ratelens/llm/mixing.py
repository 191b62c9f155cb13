"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of equal size. With a share of a in a total of A, its
i-th block (from 0) may go no earlier than slot floor(i A / a) and must go before slot
ceil((i + 1) A / a). Earliest deadline first meets all of these on one line of slots, so
at any slot each source that still has blocks is less than one block from its target.

The schedule repeats every A slots, when all sources are exactly on target. One period is
a table of A blocks, in the order of their deadlines, and A slots. As no slot stays empty
and each block takes one, earliest deadline first gives a block the first slot from its
release on that no earlier deadline takes. So the period is halved: the slots that the
earlier half of the blocks keeps busy are those of a queue, which a running sum and a
running minimum of the releases tell; these slots and blocks are one group, all others
another, and the groups are halved again, all of them at once. Groups of up to ``LEAF``
blocks are put in order by one expression each. Any other block's slot follows by
division.

Documents are put in a pseudo-random order within their source, and
their places are running sums of sizes, taken in two levels: over chunks of a source, and
within a chunk; so a source with a third of all documents is spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ratelens.session import cut_lineage

CHUNK_ROWS = 20_000
SLOT_CHUNK = 50_000
LEAF = 256
PER_SOURCE = 8  # slots for each source, where there are many

# The blocks of a group, each a struct (rank, release, source, k) and sorted by rank: at each slot the first one released.
_LEAF_ORDER = """
aggregate(
  sequence(0, size(blocks) - 1),
  named_struct('left', blocks, 'order', filter(blocks, b -> false)),
  (s, t) -> transform(
    array(filter(s.left, b -> b.release <= t)[0]),
    b -> named_struct('left', filter(s.left, c -> c.rank <> b.rank), 'order', concat(s.order, array(b))))[0],
  s -> s.order)
"""


def root_shares(docs: DataFrame, source_col: str = "source", total: int = 1000) -> DataFrame:
    """(source, share): shares in proportion to the square root of each source's number
    of documents, at least 1. They add up to about ``total``, or to ``PER_SOURCE`` times the
    number of sources where that is more. Null counts as the source ''."""
    counts = docs.groupBy(F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source")).agg(F.sqrt(F.count("*")).alias("root"))
    all_ = counts.agg(F.sum("root").alias("roots"), F.count("*").alias("n")).first()
    total = max(total, PER_SOURCE * all_["n"])
    return counts.select("source", F.greatest(F.lit(1), F.round(total * F.col("root") / F.lit(all_["roots"] or 1.0))).cast("long").alias("share"))


def _ranked(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their rank (from 0) by (due, source): ranges of the order are
    numbered apart, after the blocks that the ranges before hold."""
    ranged = cut_lineage(blocks.repartitionByRange("due", "source").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    base = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("due", "source"))
    return ranged.withColumn("inside", inside).join(base, "range").withColumn("rank", F.col("base") + F.col("inside") - 1)


def _halved(blocks: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of blocks (g, n, rank, release, source, k) and slots (g, n, t, slot), n of
    each and numbered from 0, in two: the slots that the earlier half keeps busy, numbered
    anew, with these blocks, and the rest with the others."""
    early = F.expr("rank < (n + 1) div 2")
    arrivals = blocks.where(early).groupBy("g", F.col("release").alias("t")).agg(F.count("*").alias("come"))
    line = slots.join(arrivals, ["g", "t"], "left").withColumn("come", F.coalesce("come", F.lit(0))).withColumn("chunk", F.expr(f"t div {SLOT_CHUNK}"))
    here = Window.partitionBy("g", "chunk").orderBy("t")
    line = line.withColumn("sum", F.sum("come").over(here)).withColumn("dip", F.min(F.col("sum") - F.col("t")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = line.withColumn("dip_before", F.min(F.col("sum") - F.col("t")).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    whole, before = Window.partitionBy("g").orderBy("chunk"), Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = line.groupBy("g", "chunk").agg(F.sum("come").alias("come"), F.min("dip").alias("dip")).withColumn("base", F.sum("come").over(whole) - F.col("come"))
    chunks = chunks.select("g", "chunk", "base", F.min(F.col("base") + F.col("dip")).over(before).alias("dip_chunks"))
    line = line.join(chunks, ["g", "chunk"])
    # blocks served up to a slot, and before it: the queue never serves more than have come
    served = F.least(F.col("t") + 1, F.col("t") + F.least("dip_chunks", F.col("base") + F.col("dip")))
    served_before = F.least(F.col("t"), F.col("t") - 1 + F.least("dip_chunks", F.col("base") + F.col("dip_before")))
    line = cut_lineage(line.select("g", "n", "t", "slot", served_before.alias("served"), (served > served_before).alias("busy")), "slots")

    def half(first):
        return (F.col("g") * 2 + F.when(first, 0).otherwise(1)).alias("g"), F.when(first, F.expr("(n + 1) div 2")).otherwise(F.expr("n div 2")).alias("n")

    new_slots = line.select(*half(F.col("busy")), F.when(F.col("busy"), F.col("served")).otherwise(F.col("t") - F.col("served")).alias("t"), "slot")
    blocks = blocks.join(line.select("g", F.col("t").alias("release"), "served"), ["g", "release"])
    rank = F.when(early, F.col("rank")).otherwise(F.expr("rank - (n + 1) div 2"))
    release = F.when(early, F.col("served")).otherwise(F.col("release") - F.col("served"))
    return cut_lineage(blocks.select(*half(early), rank.alias("rank"), release.alias("release"), "source", "k"), "blocks"), new_slots


def period(shares: DataFrame) -> DataFrame:
    """(source, share, total, k, slot): the slot of each source's k-th block in one
    period. Shares are whole numbers from 1. All sources may have any number of slots."""
    shares = cut_lineage(shares, "shares")
    total = shares.agg(F.sum("share")).first()[0] or 0
    blocks = shares.select("source", "share", F.explode(F.expr("sequence(0, (share - 1) div 1000)")).alias("thousand"))
    blocks = blocks.select("source", "share", F.explode(F.expr("sequence(thousand * 1000, least(thousand * 1000 + 999, share - 1))")).alias("k"))
    blocks = _ranked(blocks.select("source", "k", F.expr(f"(k * {total}) div share").alias("release"), F.expr(f"((k + 1) * {total} + share - 1) div share").alias("due")))
    blocks = blocks.select(F.lit(0).cast("long").alias("g"), F.lit(total).cast("long").alias("n"), "rank", "release", "source", "k")
    slots = shares.sparkSession.range(total).select(F.lit(0).cast("long").alias("g"), F.lit(total).cast("long").alias("n"), F.col("id").alias("t"), F.col("id").alias("slot"))
    for _ in range(math.ceil(math.log2(max(1, total / LEAF)))):
        blocks, slots = _halved(blocks, slots)
    groups = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", "release", "source", "k"))).alias("blocks"))  # at most LEAF
    placed = groups.select("g", F.posexplode(F.expr(_LEAF_ORDER)).alias("t", "b")).join(slots, ["g", "t"])
    return placed.select("b.source", "b.k", "slot").join(shares, "source").select("source", "share", F.lit(total).cast("long").alias("total"), "k", "slot")


def mixed(docs: DataFrame, shares: DataFrame | None = None, block: int = 20_000, id_col: str = "doc_id", source_col: str = "source", size=None) -> DataFrame:
    """Give every document its place in the mix: (row, source, block, slot, place), with
    ``row`` all columns of ``docs``. Reading in the order of (slot, place) yields blocks
    of ``block`` units whose sources keep to the target weights; a source that is used up
    leaves its slots empty. ``place`` is where the document starts in its source, in
    units; ``block`` is place div block. A document belongs to the block in which it
    starts, and nothing is dropped or repeated.

    ``size`` is the column to measure documents by, by default the characters of
    ``text`` (null: 0). ``shares`` are rows (source, share), share being a whole number;
    the default is ``root_shares``. A source without a share, or with one below 1, has 1;
    null counts as the source ''. Rows without an id are placed by a hash of all their
    columns; rows that repeat an id follow each other. Very long texts count whole and lie
    in the block in which they start. An empty table gives an empty one.
    """
    size = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long")
    source = F.coalesce(F.col(f"`{source_col}`"), F.lit(""))
    key, columns = F.col(f"`{id_col}`").cast("string"), [F.col(f"`{c}`") for c in docs.columns]
    mark = F.md5(F.coalesce(key, F.to_json(F.struct(*columns))))
    digits = max(2, math.ceil(math.log(max(1, docs.count()) / CHUNK_ROWS, 16)))
    rows = docs.select(F.struct(*columns).alias("row"), source.alias("source"), size.alias("size"), mark.alias("mark"), F.substring(mark, 1, digits).alias("chunk"))

    if shares is None:
        shares = root_shares(docs, source_col)
    shares = rows.select("source").distinct().join(shares.groupBy("source").agg(F.max("share").alias("share")), "source", "left")
    slots = cut_lineage(period(shares.select("source", F.greatest(F.coalesce("share", F.lit(1)), F.lit(1)).cast("long").alias("share"))), "period")

    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("size"))
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(chunks, ["source", "chunk"])
    placed = placed.withColumn("place", F.col("base") + F.col("inner")).withColumn("block", F.expr(f"place div {int(block)}"))

    cycle = slots.select("source", "share", "total").distinct()
    placed = placed.join(cycle, "source").withColumn("k", F.col("block") % F.col("share"))
    placed = placed.join(slots.select("source", "k", F.col("slot").alias("first_slot")), ["source", "k"])
    slot = F.expr("(block div share) * total + first_slot")
    return placed.select("row", "source", "block", slot.alias("slot"), "place")
