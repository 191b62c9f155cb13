"""Suffix-array deduplication of bytes by prefix-free parsing.

A rolling hash places triggers in the text: the k-gram with the smallest hash of each
run of bytes. They cut it into phrases that overlap by a whole window, so that every
suffix that matters begins inside exactly one phrase and no phrase is a prefix of
another's occurrence. The distinct phrases are the dictionary, their sequence is the
parse. Repeated text is the same phrases again, so only the dictionary has to be sorted
down to single suffixes; all other suffixes take their place from their phrase.

Deduplication asks which suffixes share their first ``length`` bytes and which of them
comes first; the order between different groups does not matter. Suffixes are therefore
brought together by a fingerprint of these bytes, not by full lexicographic order. See
``ratelens.llm.repeats`` for the steps and how they scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType

from ratelens.llm.repeats import byte_symbols, covered, later_spans, runs, with_spans
from ratelens.llm.tables import keyed, result_schema
from ratelens.llm.textblocks import text_buffer


def _apply(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        spans = batch.column("spans")
        kept, removed, pieces = [], [], []
        for i in range(batch.num_rows):
            part = data[offsets[i] : offsets[i + 1]]
            mask = covered(spans[i].as_py(), len(part)) if spans[i].is_valid else None
            kept.append(part.tobytes() if mask is None else part[~mask].tobytes())
            removed.append(0 if mask is None else int(mask.sum()))
            pieces.append(0 if mask is None else runs(mask))
        sizes = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 100, trigger: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier:
    in a document with a smaller id, or earlier in the same one. Strings lie inside one
    document and are judged on the input; overlapping copies count.

    Returns (row, n_bytes, n_removed, n_spans, kept) for every row of ``docs``: ``row``
    has all its columns but the text, ``kept`` the remaining bytes, which may end inside
    a character. Null text counts as empty. Texts shorter than ``length`` stay whole, as
    do rows without an id, which take no part. Rows that repeat an id with the same text
    each get the result of one such row; with different texts, what is found in any of
    them is removed from all at the same places. ``trigger`` is the size of the k-grams
    and does not change the result.
    """
    rows = keyed(docs, id_col, text_col)
    spans = later_spans(rows.select("doc", "text"), byte_symbols, length, trigger, across=False)
    return with_spans(rows, spans).mapInArrow(_apply, result_schema(rows, n_bytes=LongType(), n_removed=LongType(), n_spans=LongType(), kept=BinaryType()))
