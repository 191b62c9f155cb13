"""Ranked lexical search over an index that is stratified by document length.

The score of a term in a document depends on the term's weight, on its occurrences tf and
on the document's normaliser m, a whole number that follows from its length. Documents of
equal m form a stratum, in which postings are kept by tf: all documents of one posting
run score alike, so an impact is computed once for each tf of a stratum, not once for each
document. What a stratum can score for an item at most follows from the largest tf of each
term in it. Strata are visited by this bound: the first ones give every item a threshold,
its k-th best score so far; the others are passed over where their bound is lower, which
never loses a result.

A stratum of any size is split into parts of a bounded number of terms. The index holds
all terms of all documents; only its answers to a block of items meet on one machine.
Terms are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelens.llm.tables import keyed
from ratelens.llm.textblocks import BYTE_A, U64, as_long, blocks, lowered, mix, pieces, prefix_hash, span_hash, text_buffer
from ratelens.session import cut_lineage

#: A part of a stratum holds about as many distinct terms of documents, and documents.
PART_TERMS, PART_DOCS = 1 << 17, 1 << 9
#: Items and their terms in a block, which travels to all tasks, and in a slice of it.
BLOCK_ITEMS, BLOCK_TERMS, SLICE_TERMS = 1 << 12, 1 << 18, 1 << 14
#: Documents in the strata that are visited first, for each result that is wanted.
FIRST = 20

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some rows, A-Z in lower case, and for each row the number
    of its first term."""
    hashes, starts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lo, hi in pieces(data, offsets, ~_TERM):
        part = data[lo:hi]
        inside, edge = _TERM[part], np.zeros(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        edge[offsets[(offsets > lo) & (offsets < hi)] - lo] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        a, b = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        hashes.append(mix(span_hash(prefix_hash(BYTE_A[lowered(part)]), a, b)))
        starts.append(a + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counted(batches):
    salt = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for i, j in blocks(offsets):
            hashes, first = terms(data, offsets[i : j + 1])
            lengths = np.diff(first)
            row = np.repeat(np.arange(j - i), lengths)
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            at = _runs(row, hashes)
            ends = pa.array(np.searchsorted(row[at], np.arange(j - i + 1)), pa.int32())
            times = np.diff(at, append=len(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(i, j - i), pa.array(np.arange(j - i) + salt), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, as_long(hashes[at])), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                ["doc", "salt", "n", "terms", "times"],
            )
            salt += j - i


_COUNTED = "doc long, salt long, n long, terms array<long>, times array<int>"
_INDEX = "m long, part long, docs array<long>, terms array<long>, firsts array<int>, times array<int>, starts array<int>, places array<int>"


def _indexed(part: pa.Table) -> pa.Table:
    """One part of a stratum: ``docs``; sorted ``terms``; for each term its ``firsts`` of
    the runs, for each run its tf (``times``, ascending in a term) and where in ``places``,
    which number the documents, it starts."""
    part = part.combine_chunks()
    docs, lists = part.column("doc").to_numpy(), part.column("terms").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    words, times = lists.flatten().to_numpy(), part.column("times").combine_chunks().flatten().to_numpy()
    place = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    order = np.lexsort((place, times, words))
    words, times, place = words[order], times[order], place[order]
    run = _runs(words, times)
    term = _runs(words[run])

    def one(x, kind):
        return pa.array([x], pa.list_(kind))

    return pa.table(
        [part.column("m").slice(0, 1), part.column("part").slice(0, 1), one(docs, pa.int64()), one(words[run][term], pa.int64()), one(np.append(term, len(run)), pa.int32()), one(times[run], pa.int32()), one(np.append(run, len(words)), pa.int32()), one(place, pa.int32())],
        ["m", "part", "docs", "terms", "firsts", "times", "starts", "places"],
    )


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What one unit of weight scores for a term that occurs tf times."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """The items of one block, as the tasks need them: sorted distinct ``terms``, their
    ``weights``, and for each item the numbers of its terms and their counts."""

    def __init__(self, rows: list, weights: dict[int, int]):
        self.items = [r.item for r in rows]
        self.terms = np.array(sorted(weights), np.int64)
        self.weights = np.array([weights[t] for t in self.terms.tolist()], np.int64)
        self.of = [(np.searchsorted(self.terms, np.array(r.terms, np.int64)), np.array(r.times, np.int64)) for r in rows]
        # Slices of the items, and which terms they have: what a task adds up at once.
        ends = np.cumsum([len(of) for of, _ in self.of])
        self.slices = []
        for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends // SLICE_TERMS)) + 1) if len(rows) else []:
            has = np.zeros(len(self.terms), bool)
            has[np.concatenate([self.of[i][0] for i in own])] = True
            self.slices.append((own.tolist(), has))


def _frequencies(wanted: np.ndarray):
    """In how many documents of a task's parts the wanted terms occur."""

    def job(batches):
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, firsts, starts in zip(*(batch.column(c) for c in ("terms", "firsts", "starts")), strict=True):
                terms, firsts, starts = (x.values.to_numpy() for x in (terms, firsts, starts))
                at = np.searchsorted(terms, wanted)
                held = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == wanted))
                found[held] += starts[firsts[at[held] + 1]] - starts[firsts[at[held]]]
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[held]), pa.array(found[held])], ["term", "df"])

    return job


def _tops(block: Block, m: int, terms: np.ndarray, firsts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which terms of the block a part holds, where, and what each scores there at most."""
    at = np.searchsorted(terms, block.terms)
    held = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == block.terms))
    at = at[held]
    top = np.zeros(len(block.terms), np.int64)
    top[held] = impact(times[firsts[at + 1] - 1].astype(np.int64), m) * block.weights[held]
    return held, at, top


def _bounds(block: Block):
    """What each part can score for each item at most, where that is above 0."""

    def job(batches):
        for batch in batches:
            for m, part, docs, terms, firsts, times in zip(*(batch.column(c) for c in ("m", "part", "docs", "terms", "firsts", "times")), strict=True):
                _, _, top = _tops(block, m.as_py(), *(x.values.to_numpy() for x in (terms, firsts, times)))
                bound = np.array([int((top[of] * count).sum()) for of, count in block.of], np.int64)
                item = np.flatnonzero(bound)
                fixed = [pa.array(np.full(len(item), x), pa.int64()) for x in (m.as_py(), part.as_py(), len(docs))]
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), *fixed, pa.array(bound[item])], ["item", "m", "part", "size", "bound"])

    return job


def _scored(block: Block, k: int, thresholds: np.ndarray):
    """The rows (item, doc, score) of each part that may be among the k best of an item.
    Thresholds rise as the task goes on."""

    def job(batches):
        least, best = thresholds.copy(), [np.zeros(0, np.int64) for _ in block.items]
        for batch in batches:
            chosen = batch.column("items") if "items" in batch.schema.names else [None] * batch.num_rows
            columns = (batch.column(c) for c in ("docs", "terms", "firsts", "times", "starts", "places"))
            for m, items, *arrays in zip(batch.column("m"), chosen, *columns, strict=True):
                m, (docs, terms, firsts, times, starts, places) = m.as_py(), (x.values.to_numpy() for x in arrays)
                held, at, bound = _tops(block, m, terms, firsts, times)
                scores = impact(times.astype(np.int64), m)  # once for each run of equal tf
                out, chosen_items = [(np.zeros(0, np.int64),) * 3], None if items is None else set(items.as_py())
                for own, of_slice in block.slices:
                    todo = [i for i in own if (chosen_items is None or i in chosen_items) and int((bound[block.of[i][0]] * block.of[i][1]).sum()) >= max(1, least[i])]
                    if not todo:
                        continue
                    here = np.flatnonzero(of_slice[held])
                    a, b = firsts[at[here]], firsts[at[here] + 1]
                    row = np.full(len(block.terms), len(here), np.int64)  # terms that the part lacks score 0
                    row[held[here]] = np.arange(len(here))
                    table = np.zeros((len(here) + 1, len(docs)), np.int64)
                    n = starts[b] - starts[a]
                    cells = np.arange(int(n.sum())) + np.repeat(starts[a] - np.cumsum(n) + n, n)
                    which = np.repeat(np.arange(len(here)), n)
                    run = np.searchsorted(starts, cells, side="right") - 1
                    table[which, places[cells]] = scores[run] * block.weights[held[here]][which]
                    for i in todo:
                        of, count = block.of[i]
                        total = (table[row[of]] * count[:, None]).sum(axis=0)
                        keep = np.flatnonzero(total >= max(1, least[i]))
                        if len(keep) > k:
                            keep = keep[np.lexsort((docs[keep], -total[keep]))[:k]]
                        if len(keep):
                            best[i] = np.sort(np.concatenate((best[i], total[keep])))[-k:]
                            if len(best[i]) == k:
                                least[i] = max(least[i], int(best[i][0]))
                            out.append((np.full(len(keep), block.items[i], np.int64), docs[keep], total[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["item", "doc", "score"])

    return job


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _whole(x: Column, y: Column) -> Column:
    """Whole-number division of two longs that aren't negative."""
    return F.call_function("div", x, y)


class Index:
    """The index of a corpus, in written tables. ``n`` documents have terms, ``length``
    terms in all; ``parts`` are the parts of the strata, ``strata`` their sizes."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        """Index every row of ``docs`` that has an id and a term: null and empty texts,
        and rows without an id, have no part in it. Texts are indexed whole. Rows count
        and are found one by one, also where they repeat an id. Other columns are not
        read."""
        rows = keyed(docs.select(id_col, text_col), id_col, text_col).where("doc is not null")
        counted = cut_lineage(rows.select("doc", "text").mapInArrow(_counted, _COUNTED).where("n > 0"), "counted")
        self.n, self.length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        placed = counted.withColumn("m", 25 + _whole(75 * F.col("n") * F.lit(self.n), F.lit(max(1, self.length))))
        self.strata = cut_lineage(placed.groupBy("m").agg(F.count("*").alias("size"), F.sum(F.size("terms")).alias("terms")), "strata")
        parts = F.greatest(F.ceil(F.col("terms") / PART_TERMS), F.ceil(F.col("size") / PART_DOCS))
        of_m = self.strata.select("m", parts.alias("parts"))
        dealt = placed.join(of_m, "m").withColumn("part", F.pmod(F.xxhash64("salt"), "parts"))
        self.parts = cut_lineage(dealt.select("m", "part", "doc", "terms", "times").groupBy("m", "part").applyInArrow(_indexed, _INDEX), "index")

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """The k best documents for each item: (item_id, rank from 1, doc_id, score),
        best first, equal scores by ascending id. Scores of 0 are left out. Items without
        an id or a term find nothing. Repeated rows count once; texts that share an id are
        one item."""
        spark = items.sparkSession
        rows = keyed(items.select(id_col, text_col), id_col, text_col).where("doc is not null").select("doc", "text").distinct()
        flat = rows.mapInArrow(_counted, _COUNTED).select(F.col("doc").alias("item"), F.explode(F.arrays_zip("terms", "times")).alias("t"))
        flat = flat.groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.times").alias("times"))
        whole = cut_lineage(flat.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times")), "items")
        # Blocks of a bounded size: by ranges of the hash, which spread items and terms evenly.
        count, size = whole.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        n_blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_TERMS))
        whole = cut_lineage(whole.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks))), "blocks")
        found = None
        for b in range(n_blocks):
            part = self._search_block(whole.where(F.col("block") == b).drop("block"), k)
            found = part if found is None else found.unionByName(part)
        return _best(found, k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score") if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def _search_block(self, items: DataFrame, k: int) -> DataFrame:
        rows = items.collect()  # a block: BLOCK_ITEMS items or BLOCK_TERMS terms, about
        wanted = np.array(sorted({t for r in rows for t in r.terms}), np.int64)
        known = self.parts.select("terms", "firsts", "starts").mapInArrow(_frequencies(wanted), "term long, df long")
        weight = F.floor(1000 * F.log((2 * F.lit(self.n) + 2) / (2 * F.sum("df") + 1)))
        weights = known.groupBy("term").agg(weight.alias("weight")).collect()  # the terms of the block
        block = Block(rows, {t: 0 for t in wanted.tolist()} | {r.term: r.weight for r in weights})
        bounds = self.parts.select("m", "part", "docs", "terms", "firsts", "times").mapInArrow(_bounds(block), "item int, m long, part long, size long, bound long")
        w = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m", "part")
        before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = bounds.withColumn("before", before).where(F.col("before") < FIRST * k).groupBy("m", "part").agg(F.collect_list("item").alias("items"))
        first = cut_lineage(first.coalesce(1), "first")  # of a known size: the index need not move to meet it
        columns = ["m", "docs", "terms", "firsts", "times", "starts", "places"]
        none = np.zeros(len(rows), np.int64)
        tried = self.parts.select("part", *columns).join(first, ["m", "part"]).mapInArrow(_scored(block, k, none), "item long, doc long, score long")
        reached = {r.item: r.least for r in _best(tried, k).groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        thresholds = np.array([reached.get(i, 0) for i in block.items], np.int64)
        return self.parts.select(*columns).mapInArrow(_scored(block, k, thresholds), "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` (doc_id, text) and search it for all ``items`` (item_id, text); see
    ``Index`` and ``Index.search`` for what nulls, repeats and empty tables give."""
    return Index(docs).search(items, k)
