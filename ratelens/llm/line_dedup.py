"""Line deduplication by winnowing over line hashes.

Each line is hashed; of every ``run`` consecutive lines the one with the smallest hash
is a fingerprint, so any two equal runs of that many lines share a fingerprint at the
same place. ``ratelens.llm.repeats`` counts fingerprints, compares the stretches of lines
that they own with their first occurrence, and where the stretches of one fingerprint
differ, window by window.

A run of fewer lines counts as well if it is long, of ``long_words`` words or more, or if it
is a whole document. In windows of one or two lines there is nothing to winnow: each is
its own fingerprint, filed with its first place by an aggregate and met again by a join
on the hash. Any repeated run that counts is covered by windows of at most ``run`` lines
that count and repeat, so longer windows need not be looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType

from ratelens.llm.repeats import covered, later_spans, line_symbols, runs, with_spans
from ratelens.llm.tables import keyed, result_schema
from ratelens.llm.textblocks import U64, as_long, blocks, line_hashes, mix, pieces, prefix_hash, span_hash, text_buffer, word_spans
from ratelens.session import cut_lineage

_BLANKS = " \t\r"
_WHOLE = U64(1 << 32)


def _line_words(data: np.ndarray, offsets: np.ndarray, number: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The words of given lines: ``number`` among all lines of their row, and row."""
    at = np.arange(len(offsets) - 1)
    feeds, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in pieces(data, offsets):
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        held.append(word_spans(data[lo:hi], np.concatenate(([0], inner, [hi - lo])))[0] + lo)
        feeds.append(np.flatnonzero(data[lo:hi] == 10) + lo)
    feeds, starts = np.concatenate(feeds), np.concatenate(held)
    before = np.searchsorted(feeds, offsets[:-1]) + at  # lines before each row
    line = np.searchsorted(feeds, starts) + np.searchsorted(offsets, starts, side="right") - 1
    return np.bincount(line, minlength=len(feeds) + len(offsets))[before[row] + number]


def _short_runs(run: int, long_words: int):
    """Runs of fewer than ``run`` lines that count: (h, doc, lo, n)."""

    def job(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"))
            for i, j in blocks(offsets):
                part = offsets[i : j + 1]
                hashes, number, row, first = line_hashes(data, part)
                prefix = prefix_hash(hashes)
                n_words = np.concatenate(([0], np.cumsum(_line_words(data, part, number, row))))
                lines = np.diff(first)
                for n in range(1, run):
                    lo = np.arange(max(0, len(hashes) - n + 1))
                    lo = lo[(row[lo] == row[lo + n - 1]) & (n_words[lo + n] - n_words[lo] >= long_words)]
                    whole = first[:-1][lines == n]
                    at = np.concatenate((lo, whole))
                    mark = np.concatenate((np.full(len(lo), n, U64), np.full(len(whole), n, U64) | _WHOLE))
                    h = mix(span_hash(prefix, at, at + n) ^ mix(mark))
                    yield pa.RecordBatch.from_arrays([as_long(h), pa.array(ids[i + row[at]], pa.int64()), pa.array(at - first[row[at]], pa.int64()), pa.array(np.full(len(at), n), pa.int32())], ["h", "doc", "lo", "n"])

    return job


def short_spans(docs: DataFrame, run: int, long_words: int) -> DataFrame:
    """As ``later_spans``, for runs of fewer than ``run`` lines that count."""
    found = docs.where("doc is not null").select("doc", "text").mapInArrow(_short_runs(run, long_words), "h long, doc long, lo long, n int")
    found = cut_lineage(found, "short-runs")
    first = found.groupBy("h").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = cut_lineage(first.select("h", F.col("first.doc").alias("first_doc"), F.col("first.lo").alias("first_lo")), "first-short-runs")
    later = found.join(first, "h").where("doc > first_doc or lo > first_lo")
    return later.groupBy("doc").agg(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("n")).alias("end"))).alias("spans"))


def _apply(batches):
    for batch in batches:
        kept, total, removed, pieces = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
            lines = text.split("\n")
            full = [i for i, line in enumerate(lines) if line.strip(_BLANKS)]
            total.append(len(full))
            mask = covered(spans.as_py(), len(full)) if spans.is_valid else np.zeros(len(full), bool)
            gone = {full[i] for i in np.flatnonzero(mask)}
            removed.append(len(gone))
            pieces.append(runs(mask))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_removed", "n_runs", "kept"])


def line_dedup(docs: DataFrame, run: int = 3, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete the later copies of runs of consecutive lines. A run counts if it has ``run``
    or more lines, or ``long_words`` or more words, or if it is all lines of its document
    and of the earlier one. Each line covered by a run that counts and also starts earlier,
    in a document with a smaller id or earlier in the same one, is deleted. Lines end at
    line feeds and are compared without the spaces, tabs and carriage returns around them;
    blank lines do not count, break no run and stay. Words are ``[^\\x20\\x09-\\x0D]+``.
    Runs are judged on the input.

    Returns (row, n_lines, n_removed, n_runs, kept) for every row of ``docs``: ``row`` has
    all its columns but the text, ``n_lines`` counts lines that are not blank, ``n_runs``
    the maximal deleted runs, ``kept`` is the remaining text. Null text counts as empty;
    texts without lines repeat nothing. Very long texts are taken whole. Rows without an
    id stay whole and take no part. Rows that repeat an id with the same text each get the
    result of one such row; with different texts, what is found in any of them is deleted
    from all at the same places. An empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)
    texts = rows.select("doc", "text")
    spans = later_spans(texts, line_symbols, run, 1, across=False).unionByName(short_spans(texts, run, long_words))
    spans = spans.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return with_spans(rows, spans).mapInArrow(_apply, result_schema(rows, n_lines=LongType(), n_removed=LongType(), n_runs=LongType(), kept=StringType()))
