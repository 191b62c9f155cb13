"""Substring deduplication by compacting a De Bruijn graph of words.

The edges of the graph are all runs of ``window`` consecutive words; two edges that
follow each other in a text share a node. Like assemblers that split the graph by
minimizer, a task first compacts the edges of a document into paths: consecutive edges
with the same smallest k-gram, which decides the shuffle partition. A path that looks
the same wherever its minimizer occurs has no branch inside and stays one row. Where a
minimizer has several paths the graph branches, and only there paths are opened into
single edges again. Joins find the first source of each repeated path and edge; their
coordinates, joined back into maximal spans of a document, say which words go. See
``ratelens.llm.repeats`` for the steps and how they scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from ratelens.llm.repeats import covered, later_spans, runs, with_spans, word_symbols
from ratelens.llm.tables import keyed, result_schema
from ratelens.llm.textblocks import blocks, text_buffer, words

K = 20


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, size: int) -> bytes:
    """Some words of a text of ``size`` bytes, with one space between them."""
    if not len(starts):
        return b""
    change = np.zeros(size + 2, np.int8)
    change[starts - base] += 1
    change[ends - base + 1] -= 1  # a word and the byte after it
    text = np.empty(size + 1, np.uint8)
    text[:size] = data[base : base + size]
    text[ends - base] = 32
    return text[np.cumsum(change[:-1], dtype=np.int8) > 0][:-1].tobytes()


def _apply(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        spans = batch.column("spans")
        kept, total, removed, pieces = [], [], [], []
        for i, j in blocks(offsets):
            _, starts, ends, first = words(data, offsets[i : j + 1])
            for row in range(i, j):
                s, e = starts[first[row - i] : first[row - i + 1]], ends[first[row - i] : first[row - i + 1]]
                total.append(len(s))
                mask = covered(spans[row].as_py(), len(s)) if spans[row].is_valid else np.zeros(len(s), bool)
                removed.append(int(mask.sum()))
                pieces.append(runs(mask))
                kept.append(_joined(data, s[~mask], e[~mask], int(offsets[row]), int(offsets[row + 1] - offsets[row])).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a run of ``window`` words that also starts in a
    document with a smaller id. Words are ``[^\\x20\\x09-\\x0D]+``, taken as they are; runs
    lie in one document and are judged on the input. Repeats within one document stay.

    Returns (row, n_words, n_removed, n_spans, kept) for every row of ``docs``: ``row``
    has all its columns but the text, ``kept`` the remaining words joined by one space.
    Null text has no words. Texts with fewer words than ``window`` keep all, as do rows
    without an id, which take no part. Rows that repeat an id with the same text each get
    the result of one such row; with different texts, what is found in any of them is
    removed from all at the same places.
    """
    rows = keyed(docs, id_col, text_col)
    spans = later_spans(rows.select("doc", "text"), word_symbols, window, min(K, (window + 1) // 2), across=True)
    return with_spans(rows, spans).mapInArrow(_apply, result_schema(rows, n_words=LongType(), n_removed=LongType(), n_spans=LongType(), kept=StringType()))
