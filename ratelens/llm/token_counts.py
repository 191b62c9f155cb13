"""Token counts by section, from one encoding of the whole text.

A text is encoded once, as a model would see it; sections are never encoded by
themselves, which would give other tokens at their edges. The tokens' lengths in bytes
give each token's place, and a merge of token places with section places, both in
order, attributes the tokens. **Rule:** a token belongs to the section that holds its
first byte, also where it ends in a later one; so the counts of the sections add up to
the count of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ratelens.llm.tables import keyed

#: Fixed value: the pattern that splits text before the merges of the given rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(ranks: str, pattern: str):
    """The encoding of a rank file, made once for each Python worker."""
    import tiktoken
    from tiktoken.registry import ENCODINGS

    if ranks not in ENCODINGS:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ENCODINGS[ranks] = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return ENCODINGS[ranks]


def line_starts(text: bytes) -> np.ndarray:
    """Sections that begin with the text and after each line feed but a last one."""
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate(([0], feeds[feeds < len(text)]))


def attribute(token_bytes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sections that start at given bytes: the tokens of each, and how many of them
    end in a later section."""
    ends = np.cumsum(token_bytes)
    first = np.searchsorted(starts, ends - token_bytes, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    return np.bincount(first, minlength=len(starts)), np.bincount(first[first != last], minlength=len(starts))


def _counted(ranks: str, pattern: str, sections: Callable[[bytes], np.ndarray]):
    def job(batches):
        tokens = encoder(ranks, pattern)
        sizes = np.zeros(tokens.n_vocab, np.int64)
        for token in tokens.token_byte_values():
            sizes[tokens.encode_single_token(token)] = len(token)
        for batch in batches:
            found = []
            for row, value in enumerate(batch.column("text").to_pylist()):
                text = value.encode()
                starts = sections(text)
                count, crossing = attribute(sizes[tokens.encode_ordinary(value)], starts)
                # characters before each byte, to give places as a user of strings sees them
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                found.append((np.full(len(starts), row), np.arange(len(starts)), chars[starts], chars[np.append(starts[1:], len(text))], count, crossing))
            if found:
                row, section, start, end, count, crossing = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [batch.column("row").take(pa.array(row)), pa.array(section, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, end, count, crossing))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return job


def token_counts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, sections: Callable[[bytes], np.ndarray] = line_starts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section of each row of ``docs``: (row, section from 0, start_char,
    end_char, n_tokens, n_crossing). ``row`` has all columns but the text; the section is
    the characters from ``start_char`` up to ``end_char``; ``n_tokens`` counts its tokens
    and ``n_crossing`` those of them that end in a later section. ``sections`` maps a
    text in UTF-8 to the ascending first bytes of its sections, 0 being the first; lines
    are the default. Special-token strings in a text are ordinary text.

    An empty or null text has one section of no characters and no tokens. Nulls in other
    columns and repeated rows do not matter; each row is counted by itself, whole. The
    rank file must be readable on the executors under the path ``ranks``.
    """
    rows = keyed(docs, id_col, text_col).select("row", "text")
    kinds = {"section": IntegerType(), "start_char": LongType(), "end_char": LongType(), "n_tokens": LongType(), "n_crossing": LongType()}
    return rows.mapInArrow(_counted(ranks, pattern, sections), StructType([rows.schema["row"], *(StructField(n, t) for n, t in kinds.items())]))
