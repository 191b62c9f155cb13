"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so similarity says little; what counts is the
share of an item's word shingles that a document contains. Items are partitioned by the
number of their shingles, each partition holding sizes up to a power of two. Within a
partition an item is indexed by its MinHash sketch, the smallest hashes of its shingles,
as many as an item of the partition's largest size may miss at the threshold, and one
more. Shingles that fewer items share come before others, so that a stock phrase of many
items is in a sketch only where nothing else is left. A document that contains enough of
an item therefore meets its sketch for certain, whichever shingles it has, and candidates
are found by one equality join on single hashes. Each candidate is then verified on the
shingles themselves. Items too short for a shingle are looked up whole,
among the documents' runs of as many words; where there are none, no run is made.

Everything is column expressions. The sketches are joined by Catalyst's own choice: a
benchmark below the broadcast limit is never shuffled against, a larger one is a shuffle
join on a 64-bit hash. A popular item costs one row for each document that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratelens.llm.tables import without
from ratelens.session import cut_lineage


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _windows(w: Column, k: int, make) -> Column:
    """``make`` of each run of k words."""
    at = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(at, lambda i: make(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array())


def shingle_hashes(w: Column, k: int) -> Column:
    return _windows(w, k, F.xxhash64)


def shingle_texts(w: Column, k: int) -> Column:
    return _windows(w, k, lambda *x: F.concat_ws(" ", *x))


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_id, hash): the sketch of each item (item_id, w). Counts are of texts, so that
    copies of an item make none of its shingles common."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), k))).alias("hashes")).where("size(hashes) > 0")
    texts = hashed.select("hashes").distinct().select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n_texts"))
    ranked = hashed.select("item_id", F.xxhash64("hashes").alias("text"), F.explode("hashes").alias("hash")).join(texts, "hash")
    # rows that repeat an id with another text are sketched apart; a sketch is as long as a benchmark item at most
    sized = ranked.groupBy("item_id", "text").agg(F.array_sort(F.collect_set(F.struct("n_texts", "hash"))).alias("hashes")).select("item_id", F.col("hashes.hash").alias("hashes"))
    partition = F.ceil(F.log2(F.size("hashes"))).cast("int")  # holds sizes up to 2 to this power
    most_missed = F.floor(F.pow(F.lit(2.0), partition) * (100 - percent) / 100).cast("int")
    return sized.select("item_id", F.explode(F.slice("hashes", F.lit(1), most_missed + 1)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item of which the document contains at least
    ``percent`` hundredths of the distinct word shingles: (doc_id, item_id, n_shingles,
    n_found, containment). Words are runs of letters and digits in lower case, so case,
    punctuation and spacing make no difference.

    An item of fewer than k words is one shingle, of all its words. Items without words
    match nothing, nor do null or empty texts; very long texts are searched whole. Rows
    without an id, on either side, take no part. Rows that repeat an id count once; where
    their texts differ, the best of them counts. Other columns are not looked at.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("w")).where("doc_id is not null")
    items = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), words(F.coalesce(F.col(f"`{item_text_col}`"), F.lit(""))).alias("w")).where("item_id is not null")
    probes = docs.select("doc_id", F.explode(shingle_hashes(F.col("w"), k)).alias("hash"))
    candidates = cut_lineage(probes.join(sketches(items, k, percent), "hash").select("doc_id", "item_id").distinct(), "candidates")
    shingles = items.select("item_id", F.array_distinct(shingle_texts(F.col("w"), k)).alias("item_shingles"))
    pairs = docs.join(candidates, "doc_id").join(shingles, "item_id")
    pairs = pairs.select("doc_id", "item_id", F.size("item_shingles").alias("n_shingles"), F.size(F.array_intersect("item_shingles", shingle_texts(F.col("w"), k))).alias("n_found"))
    few = items.where(F.size("w").between(1, k - 1)).select("item_id", F.size("w").alias("n"), F.concat_ws(" ", "w").alias("phrase"))
    lengths = sorted(r["n"] for r in few.select("n").distinct().collect())
    if lengths:
        held = F.concat(*(F.array_distinct(shingle_texts(F.col("w"), n)) for n in lengths))
        whole = docs.select("doc_id", F.explode(held).alias("phrase")).join(few, "phrase")
        pairs = pairs.unionByName(whole.select("doc_id", "item_id", F.lit(1).alias("n_shingles"), F.lit(1).alias("n_found")))
    best = pairs.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).groupBy("doc_id", "item_id")
    best = best.agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_found", "best.containment")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, as they are, that contain no test item; rows without an id
    stay. Columns of any name pass through. See ``contained``."""
    return without(docs, cut_lineage(contained(docs, items, id_col=id_col, **options).select("doc_id").distinct(), "contaminated"), id_col)
