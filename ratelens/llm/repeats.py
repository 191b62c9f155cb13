"""Where windows of a sequence occur again, exactly, in any number of documents.

A document is a sequence of symbols (bytes, words or lines). A *window* is ``length``
consecutive symbols of one document. ``later_spans`` gives the stretches of each
document that are covered by windows which also start earlier. It is the shared core of
the byte, word and line deduplication.

Every window holds ``length - k + 1`` k-grams; the one with the smallest hash, the
leftmost among equals, owns it. Equal windows have equal owners at the same place in
them, and neighbouring windows mostly share their owner. So a document falls into
*phrases*: runs of windows with one owner, which start and end where the content says,
not where the document starts. Then, by shuffles of one row for each phrase:

1. Owners are counted, partly in the tasks. Phrases whose owner occurs once repeat
   nothing; they go no further.
2. The distinct phrases of the rest form a dictionary with the first place of each.
   Every later occurrence of a phrase is repeated as a whole.
3. Only where one owner has several different phrases, that is where copies begin, end
   or differ, can single windows repeat; each distinct phrase takes part once. Its windows
   are first judged by the part that neighbours have in common, their *core*: equal windows
   have equal cores, so only windows whose core occurs again are compared one by one.

Groups are only counted and reduced to their first member; no pairs are made and no
group is collected, so copies by the thousand, or a passage in a third of all documents,
cost what their rows cost. Equality is that of an owner's 64-bit hash together with an
independent 64-bit hash of the phrase or window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratelens.llm.textblocks import BYTE_A, BYTE_B, U64, as_long, blocks, line_hashes, mix, powers, prefix_hash, span_hash, text_buffer, words
from ratelens.session import cut_lineage

_LOW = U64(0xFFFFFFFF)
_HIGH = U64(0xFFFFFFFF00000000)
CHUNK = 1 << 18
BLOCKS = 4

#: Two symbol values for each symbol of some rows, and the rows' bounds in symbols.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def byte_symbols(data, offsets):
    part = data[offsets[0] : offsets[-1]]
    return BYTE_A[part], BYTE_B[part], offsets - offsets[0]


def word_symbols(data, offsets):
    hashes, _, _, first = words(data, offsets)
    return hashes, mix(hashes + U64(1)), first


def line_symbols(data, offsets):
    """Lines that hold more than blanks; their outer blanks do not count."""
    hashes, _, _, first = line_hashes(data, offsets)
    return hashes, mix(hashes + U64(1)), first


def phrases(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each phrase of some rows: its row, first window, number of windows, the hash
    of its owner, a hash of the whole phrase, and how far its owner is from its start."""
    parts = []
    for at in range(0, max(0, len(a) - length + 1), CHUNK):
        parts.append(_phrases(a[at : at + CHUNK + length - 1], b[at : at + CHUNK + length - 1], bounds, at, length, k))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _phrases(a, b, bounds, at, length, k):
    n, width = len(a) - length + 1, length - k + 1
    prefix = prefix_hash(a)
    rank = mix((prefix[k:] - prefix[:-k]) * powers(len(prefix))[1][: len(a) - k + 1])
    least, span = (rank & _HIGH) | np.arange(len(rank), dtype=U64), 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    change = np.zeros(n + 1, np.int32)  # which windows lie in one row
    lo, hi = np.clip(bounds[:-1] - at, 0, n), np.clip(bounds[1:] - length + 1 - at, 0, n)
    held = hi > lo
    np.add.at(change, lo[held], 1)
    np.add.at(change, hi[held], -1)
    windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    owner = (least[windows] & _LOW).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)
    row_start = np.zeros(n + 1, bool)
    row_start[lo[held]] = True
    new |= row_start[windows]
    runs = np.flatnonzero(new)
    start, count, owner = windows[runs], np.diff(np.append(runs, len(windows))), owner[runs]
    shape = ((owner - start).astype(U64) << U64(32)) | count.astype(U64)
    whole = mix(span_hash(prefix_hash(b), start, start + count - 1 + length) ^ mix(shape))
    rows = np.searchsorted(bounds, start + at, side="right") - 1
    return rows, start + at - bounds[rows], count, rank[owner], whole, owner - start


def _found(batch: pa.RecordBatch, symbols: Symbols, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    data, offsets = text_buffer(batch.column("text"))
    for i, j in blocks(offsets):
        rows, *rest = phrases(*symbols(data, offsets[i : j + 1]), length, k)
        yield rows + i, *rest


def _owners(symbols, length, k):
    def job(batches):
        for batch in batches:
            owners = [x[3] for x in _found(batch, symbols, length, k)] or [np.zeros(0, U64)]
            g, n = np.unique(np.concatenate(owners), return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(g), pa.array(n, pa.int64())], ["g", "n"])

    return job


def _occurrences(symbols, length, k):
    def job(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for rows, lo, n, g, t, o in _found(batch, symbols, length, k):
                yield pa.RecordBatch.from_arrays([as_long(g), as_long(t), pa.array(ids[rows], pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(o, pa.int32())], ["g", "t", "doc", "lo", "n", "o"])

    return job


def _cores(symbols, length, k):
    """Windows of given phrases in blocks, by how far the owner is from their start, with a
    hash of the owner, of the block, and of the symbols that all windows of a block hold."""
    width = length - k + 1
    step = -(-width // BLOCKS)

    def job(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"))
            wanted = batch.column("wanted")
            for i, j in blocks(offsets):
                _, b, bounds = symbols(data, offsets[i : j + 1])
                prefix = prefix_hash(b)
                for row in range(i, j):
                    items = wanted[row].as_py()
                    base, end = bounds[row - i], bounds[row - i + 1]
                    lo, n, o, g = (np.array([x[c] for x in items], np.int64) for c in ("lo", "n", "o", "g"))
                    least, most = (o - n + 1) // step, o // step
                    count = most - least + 1
                    item = np.repeat(np.arange(len(items)), count)
                    q = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + least[item]
                    lo, n, o, g = lo[item], n[item], o[item], g[item]
                    far, near = np.minimum(o, (q + 1) * step - 1), np.maximum(o - n + 1, q * step)
                    core = lo + o - q * step, lo + o + length - np.minimum((q + 1) * step, width) + 1
                    held = (core[0] >= 0) & (core[1] <= end - base)  # texts may differ that repeat an id
                    lo, n, o, g, q, far, near = (x[held] for x in (lo, n, o, g, q, far, near))
                    c = mix(span_hash(prefix, base + core[0][held], base + core[1][held]) ^ mix(g.astype(U64) + q.astype(U64)))
                    yield pa.RecordBatch.from_arrays(
                        [as_long(c), pa.array(g), pa.array(np.full(len(g), ids[row]), pa.int64()), pa.array(lo + o - far), pa.array((far - near + 1).astype(np.int32))],
                        ["c", "g", "doc", "lo", "n"],
                    )

    return job


def _windows(symbols, length):
    """Hashes of the single windows of given phrases."""

    def job(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"))
            wanted = batch.column("wanted")
            for i, j in blocks(offsets):
                _, b, bounds = symbols(data, offsets[i : j + 1])
                prefix = prefix_hash(b)
                for row in range(i, j):
                    items = wanted[row].as_py()
                    base, end = bounds[row - i], bounds[row - i + 1]
                    lo = np.array([x["lo"] for x in items], np.int64)
                    n = np.array([x["n"] for x in items], np.int64)
                    n = np.clip(n, 0, np.maximum(0, end - base - length + 1 - lo))
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    h = mix(span_hash(prefix, base + at, base + at + length))
                    g = np.repeat(np.array([x["g"] for x in items], np.int64), n)
                    yield pa.RecordBatch.from_arrays([pa.array(g), as_long(h), pa.array(np.full(len(at), ids[row]), pa.int64()), pa.array(at, pa.int64())], ["g", "h", "doc", "at"])

    return job


def later_spans(docs: DataFrame, symbols: Symbols, length: int, k: int, across: bool) -> DataFrame:
    """Rows (doc, spans): for each document of ``docs`` (doc, text) that has any, the
    stretches [start, end) of symbols covered by windows that also start earlier. Spans
    may overlap and come in no order. ``across``: earlier means in a document with a
    smaller id; otherwise an earlier place of the same document counts as well."""
    docs = docs.where(F.col("doc").isNotNull())
    seen = docs.select("text").mapInArrow(_owners(symbols, length, k), "g long, n long")
    shared = cut_lineage(seen.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "owners")
    occurrences = docs.select("doc", "text").mapInArrow(_occurrences(symbols, length, k), "g long, t long, doc long, lo long, n int, o int")
    occurrences = cut_lineage(occurrences.join(shared, "g"), "occurrences")

    first = occurrences.groupBy("g", "t").agg(F.min(F.struct("doc", "lo")).alias("first"))
    dictionary = cut_lineage(first.select("g", "t", F.col("first.doc").alias("first_doc"), F.col("first.lo").alias("first_lo")), "dictionary")
    later = (F.col("doc") > F.col("first_doc")) if across else (F.col("doc") > F.col("first_doc")) | (F.col("lo") > F.col("first_lo"))
    judged = occurrences.join(dictionary, ["g", "t"]).withColumn("later", later)

    varied = cut_lineage(dictionary.groupBy("g").count().where("count > 1").select("g"), "varied")
    open_ = judged.where("not later").join(varied, "g").groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "g", "o")).alias("wanted"))
    if length - k >= BLOCKS:  # else a core is a window
        cores = docs.join(open_, "doc").select("doc", "text", "wanted").mapInArrow(_cores(symbols, length, k), "c long, g long, doc long, lo long, n int")
        cores = cut_lineage(cores, "cores")
        again = cores.groupBy("c").count().where("count > 1").select("c")
        open_ = cores.join(again, "c").groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "g")).alias("wanted"))
    windows = docs.join(open_, "doc").select("doc", "text", "wanted").mapInArrow(_windows(symbols, length), "g long, h long, doc long, at long")
    windows = cut_lineage(windows, "windows")
    first = windows.groupBy("g", "h").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut_lineage(first.select("g", "h", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at")), "first-windows")
    later = (F.col("doc") > F.col("first_doc")) if across else (F.col("doc") > F.col("first_doc")) | (F.col("at") > F.col("first_at"))

    spans = judged.where("later").select("doc", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    spans = spans.unionByName(windows.join(first, ["g", "h"]).where(later).select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (doc, ...) with the spans of their document, or null. The spans are written
    first, so that what finds them and the texts are not on disk as shuffles together."""
    return rows.join(cut_lineage(spans, "spans"), "doc", "left")


def covered(spans: list | None, n: int) -> np.ndarray:
    """Which of n symbols lie in the spans."""
    change = np.zeros(n + 1, np.int32)
    if spans:
        s = np.array([(x["start"], x["end"]) for x in spans], np.int64)
        np.add.at(change, np.minimum(s[:, 0], n), 1)
        np.add.at(change, np.minimum(s[:, 1], n), -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> int:
    """The number of maximal runs of True."""
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
