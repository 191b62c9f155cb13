"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard tests.

One permutation of the 2^32 shingle values is the shingle hash; a second one is used
``HASHES`` times, its argument shifted by one each time, which gives all coordinates of
a signature from two permutations. Bands of ``ROWS`` coordinates are shuffled as one
64-bit value each.

Steps: (1) equal shingle sets become one class, represented by its smallest id;
(2) in every bucket of a band each class is tried against the bucket's leader, the member
that shares most buckets with others, which is the text that copies were made from if
they were made from one; the links that hold join components; (3) of what shares a bucket and is still in
different components, each pair that may be near is tried once. So a group of thousands of near copies
costs one test for each copy and bucket at most, no link between different texts is
lost that the bands can show, and pairs inside a component are never made. A pair at the
threshold of 0.8 escapes all bands with a probability of 3e-6. Before a pair is tested on
its full sets, sizes and one bit of each of 128 coordinates must agree well enough, which
a pair at the threshold fails with a probability of 2e-11. The last filter loses
nothing: every set is also a bitmap of ``MAP_BITS``, and two sets have no more shingles
in common than their bitmaps have bits, and the one with fewer such shingles that found
their bit taken. Copies of one text that are almost, but not quite near each other, of
which a group may hold as many pairs as it likes, are told apart by it before a pair is
made of them. What is still open in a bucket is compared in numpy, in tiles of two parts of
the bucket: no row is made of a pair that the filters reject, nor of two members of one
component, a task holds one tile, and a large bucket is many tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratelens.llm.components import components
from ratelens.llm.tables import keyed
from ratelens.llm.textblocks import U64, as_long, blocks, mix, text_buffer, words
from ratelens.session import cut_lineage

BANDS, ROWS, HASHES = 32, 5, 160
SKETCH, MOST_BITS, MAP_BITS = 128, 42, 4096
#: Members of a part of a bucket, about, and pairs that are compared at once.
PART, AT_ONCE = 8192, 1 << 17
_WEIGHTS = mix(np.arange(1, 65, dtype=U64)) | U64(1)
_SIGNATURE = "doc long, size long, f0 long, f1 long, s0 long, s1 long, bands array<long>, taken long, map array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of k words; with fewer words,
    that of the whole sequence."""
    w, _, _, first = words(data, offsets, lower=True)
    h = np.full(max(0, len(w) - k + 1), k, U64)
    for i in range(k):
        h += w[i : i + len(h)] * _WEIGHTS[i]
    h, sets = mix(h), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            sets.append(mix(np.array([(w[a:b] * _WEIGHTS[: b - a]).sum() + U64(b - a)], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit values."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES coordinates for each set; the sets aren't empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    i = 0
    while i < len(sets):  # as many sets at a time as fit the cache
        j, total = i + 1, len(sets[i])
        while j < len(sets) and total + len(sets[j]) <= 1 << 15:
            total += len(sets[j])
            j += 1
        values = (np.concatenate(sets[i:j]) >> U64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        for shift in range(HASHES):
            out[i:j, shift] = np.minimum.reduceat(_permuted(values + np.uint32(shift)), starts)
        i = j
    return out


def _signed(k: int):
    def job(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in blocks(offsets):
                sets = shingle_sets(data, offsets[i : j + 1], k)
                full = [n for n, s in enumerate(sets) if len(s)]
                sig = signatures([sets[n] for n in full]).astype(U64)
                prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                bands, sketch = np.zeros((len(full), BANDS), U64), np.zeros((len(sets), 2), U64)
                for band in range(BANDS):
                    h = np.full(len(full), band + 1, U64)
                    for r in range(ROWS):
                        h = mix(h * _WEIGHTS[r] + sig[:, band * ROWS + r])
                    bands[:, band] = h
                for bit in range(SKETCH):
                    sketch[full, bit // 64] |= (mix(sig[:, bit]) & U64(1)) << U64(bit % 64)
                bits = np.zeros((len(sets), MAP_BITS), bool)
                bits[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.concatenate(sets) & U64(MAP_BITS - 1)).astype(np.int64)] = True
                taken = np.array([len(s) for s in sets]) - bits.sum(axis=1)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (MAP_BITS // 64), pa.int32()), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()))
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[np.array(full, np.int64) + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), as_long(prints[:, 0]), as_long(prints[:, 1]), as_long(sketch[:, 0]), as_long(sketch[:, 1]), pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), as_long(bands.ravel())), pa.array(taken, pa.int64()), bits],
                    ["doc", "size", "f0", "f1", "s0", "s1", "bands", "taken", "map"],
                )

    return job


def _sets(k: int):
    def job(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in blocks(offsets):
                sets = shingle_sets(data, offsets[i : j + 1], k)
                ends = np.cumsum([0, *(len(s) for s in sets)])
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), as_long(np.concatenate(sets)))], ["doc", "shingles"])

    return job


def _may_share(percent: int) -> Column:
    """Whether the most that the sets of a and b can have in common is enough."""
    common = [F.bit_count(F.get("a_map", F.lit(i)).bitwiseAND(F.get("b_map", F.lit(i)))) for i in range(MAP_BITS // 64)]
    most = sum(common[1:], common[0]) + F.least("a_taken", "b_taken")
    return 100 * most >= percent * (F.col("a_size") + F.col("b_size") - most)


def _ends(changed: np.ndarray) -> np.ndarray:
    """For each row, the end of its run; ``changed`` says which rows after the first begin one."""
    cuts = np.flatnonzero(changed) + 1
    return np.append(cuts, len(changed) + 1)[np.searchsorted(cuts, np.arange(len(changed) + 1), "right")]


def near_in_tiles(c: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of members of different components that may be near. The rows are in
    the order of band, i, j, part, component; a tile (band, i, j) is part i of a bucket
    against part j, or against itself."""
    n = len(c["doc"])
    other = np.zeros(max(0, n - 1), bool)
    ends = []
    for names in (("band", "i", "j"), ("part",), ("component",)):
        for name in names:
            other = other | (c[name][1:] != c[name][:-1])
        ends.append(_ends(other) if n else np.zeros(0, np.int64))
    tile, part, component = ends
    # what a row is compared with lies behind it, up to the end of its tile
    start = np.where(c["i"] == c["j"], component, np.where(c["part"] == c["i"], part, tile))
    before = np.concatenate(([0], np.cumsum(tile - start)))
    found, row = [], 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(before, before[row] + AT_ONCE, "right")) - 1)
        many = (tile - start)[row:last]
        a = np.repeat(np.arange(row, last), many)
        b = np.arange(len(a)) - np.repeat(before[row:last] - before[row] - start[row:last], many)
        ok = (c["component"][a] != c["component"][b]) & (100 * np.minimum(c["size"][a], c["size"][b]) >= percent * np.maximum(c["size"][a], c["size"][b]))
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(c["s0"][a] ^ c["s0"][b]).astype(np.int64) + np.bitwise_count(c["s1"][a] ^ c["s1"][b]) <= MOST_BITS
        a, b = a[ok], b[ok]
        for x in range(0, len(a), 1 << 13):
            u, v = a[x : x + (1 << 13)], b[x : x + (1 << 13)]
            most = np.bitwise_count(c["map"][u] & c["map"][v]).sum(axis=1, dtype=np.int64) + np.minimum(c["taken"][u], c["taken"][v])
            ok = 100 * most >= percent * (c["size"][u] + c["size"][v] - most)
            found.append((c["doc"][u[ok]], c["doc"][v[ok]]))
        row = last
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def _in_tiles(percent: int):
    def rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        c = {name: batch.column(name).to_numpy() for name in ("band", "i", "j", "part", "component", "doc", "size", "s0", "s1", "taken")}
        c |= {name: c[name].view(U64) for name in ("s0", "s1")}
        return c | {"map": batch.column("map").flatten().to_numpy().view(U64).reshape(-1, MAP_BITS // 64)}

    def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in near_in_tiles(c, percent)], ["a", "b"])

    def job(batches):
        kept = None  # the tile that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            new = rows(batch)
            kept = new if kept is None else {name: np.concatenate((kept[name], new[name])) for name in new}
            last = np.flatnonzero((kept["band"] != kept["band"][-1]) | (kept["i"] != kept["i"][-1]) | (kept["j"] != kept["j"][-1]))
            if len(last):
                yield pairs({name: x[: last[-1] + 1] for name, x in kept.items()})
                kept = {name: x[last[-1] + 1 :] for name, x in kept.items()}
        if kept is not None:
            yield pairs(kept)

    return job


def _tested(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough."""
    pairs = cut_lineage(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = texts.hint("merge").join(wanted, "doc").dropDuplicates(["doc"]).mapInArrow(_sets(k), "doc long, shingles array<long>")
    sets = cut_lineage(sets, "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the documents whose sets of word k-grams have a Jaccard similarity of
    ``percent`` hundredths or more, directly or through others. A-Z is lower-cased, words
    are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than k words has its whole sequence as its
    one shingle, and one without words, or null, an empty set, linked with nothing.

    Returns (row, n_shingles, component_id, kept) for every row of ``docs``: ``row`` has
    all its columns but the text, ``component_id`` is the smallest id of the group, and
    ``kept`` says whether that is the row's own. Rows that share an id count as one
    document, for which one of its sets stands where they differ. Rows without an id take
    no part: their component is null and they are kept. Repeated rows of one kept id are
    all kept. The bands are made for thresholds of 70 and more.
    """
    rows = keyed(docs, id_col, text_col)
    texts = rows.select("doc", "text")
    signed = cut_lineage(texts.where("doc is not null").mapInArrow(_signed(k), _SIGNATURE), "signatures")
    full = signed.where("size > 0")

    classes = cut_lineage(full.groupBy("f0", "f1").agg(F.min("doc").alias("rep")), "classes")
    reps = full.join(classes.withColumnRenamed("rep", "doc"), ["f0", "f1", "doc"]).dropDuplicates(["doc"])
    reps = cut_lineage(reps.select("doc", "size", "s0", "s1", "bands", "taken", "map"), "representatives")
    buckets = reps.select("doc", F.explode("bands").alias("band"))
    shared = cut_lineage(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = cut_lineage(buckets.join(shared, "band"), "members")
    # what copies were made from shares more buckets with them than they do among themselves
    known = cut_lineage(members.groupBy("doc").agg(F.sum("n").alias("popularity")), "popularity")
    members = members.select("band", "doc").join(known, "doc")
    leaders = cut_lineage(members.groupBy("band").agg(F.max_by("doc", F.struct("popularity", -F.col("doc"))).alias("leader")), "leaders")
    shared_members = cut_lineage(members.select("band", "doc").join(leaders, "band"), "led")

    outline = reps.select("doc", "size", "s0", "s1", "taken", "map")
    left, right = outline.toDF("a", "a_size", "a0", "a1", "a_taken", "a_map"), outline.toDF("b", "b_size", "b0", "b1", "b_taken", "b_map")
    near = (F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= MOST_BITS) & (
        100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    )
    first = shared_members.where("doc != leader").select(F.least("leader", "doc").alias("a"), F.greatest("leader", "doc").alias("b")).distinct()
    first = cut_lineage(first.join(left, "a").join(right, "b").where(near & _may_share(percent)).select("a", "b"), "first-pairs")
    links = cut_lineage(_tested(first, texts, k, percent), "tested")

    joined = cut_lineage(components(links), "joined")
    placed = shared_members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = cut_lineage(placed, "placed")
    parts = F.ceil(F.count("*") / F.lit(PART)).cast("int")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), parts.alias("parts")).where("x < y").select("band", "parts")
    open_ = placed.join(mixed, "band").select("band", "component", "doc", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    open_ = cut_lineage(open_.select("band", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "component", "doc"), "open")
    tiles = open_.join(outline, "doc").select(*open_.columns, "size", "s0", "s1", "taken", "map")
    tiles = tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "part", "component")
    rest = tiles.mapInArrow(_in_tiles(percent), "a long, b long")
    links = links.unionByName(_tested(rest.distinct().join(first, ["a", "b"], "left_anti"), texts, k, percent))
    joined = cut_lineage(components(links), "joined").withColumnRenamed("node", "rep")

    found = classes.join(joined, "rep", "left").select("f0", "f1", F.coalesce("component", "rep").alias("component_id"))
    of_doc = signed.join(found, ["f0", "f1"], "left").groupBy("doc").agg(F.max("size").alias("n_shingles"), F.coalesce(F.min("component_id"), F.col("doc")).alias("component_id"))
    result = rows.select("doc", "row").join(of_doc, "doc", "left")
    return result.select("row", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc"), F.lit(True)).alias("kept"))
