"""Vectorised helpers over the UTF-8 buffers of Arrow text columns.

They run inside ``mapInArrow`` tasks. A batch is handled in blocks of a few megabytes,
so that the arrays of a task stay small whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(7)
#: A random 64-bit value for each byte, for two independent rolling hashes.
BYTE_A = _RNG.integers(0, 2**64, 256, dtype=U64)
BYTE_B = _RNG.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK_BYTES = 1 << 20

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64, and those of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, BLOCK_BYTES * 2), base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value times power; differences give the hash of any span."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span that does not depend on where the span lies."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_FEED = np.zeros(256, bool)
_FEED[10] = True


def pieces(data: np.ndarray, offsets: np.ndarray, at: np.ndarray = _SPACE, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that cover all rows. They end with a row or, in a
    longer row, where a byte of ``at`` stands, so that no word or line is cut."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + limit, end)
        row = int(np.searchsorted(offsets, hi, side="right")) - 1
        if offsets[row] > lo:
            hi = int(offsets[row])
        elif hi < end:
            stop = int(offsets[row + 1])
            while hi < stop:
                found = np.flatnonzero(at[data[hi : min(hi + 4096, stop)]])
                if len(found):
                    hi += int(found[0])
                    break
                hi = min(hi + 4096, stop)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of all words of some rows, and for each row the
    number of its first word."""
    found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in pieces(data, offsets):
        part = data[lo:hi]
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        starts, ends, _ = word_spans(part, np.concatenate(([0], inner, [hi - lo])))
        h = prefix_hash(BYTE_A[lowered(part) if lower else part])
        found.append((mix(span_hash(h, starts, ends)), starts + lo, ends + lo))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block whose rows begin at ``offsets``: their
    starts and ends, and for each row the number of its first word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    return starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a block, without their line feeds: starts, ends, first line of each row.
    A row of n line feeds has n + 1 lines, some of them perhaps empty."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], feeds)), kind="stable")
    return starts, ends, np.searchsorted(feeds, offsets) + np.arange(len(offsets))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0D]] = True


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, for the lines that hold more than blanks, without the spaces, tabs
    and carriage returns around them. Lines are numbered among all lines of their row;
    the second array has these numbers, the third the row of each line."""
    found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    seen: dict[int, int] = {}
    for lo, hi in pieces(data, offsets, _FEED):
        part = data[lo:hi]
        rows = np.flatnonzero((offsets[:-1] < hi) & (offsets[1:] > lo))
        inner = np.clip(offsets[np.append(rows, rows[-1] + 1)] - lo, 0, hi - lo)
        starts, ends, first = line_spans(part, inner)
        row = np.repeat(np.arange(len(rows)), np.diff(first))
        number = np.arange(len(starts)) - first[row]
        at = int(rows[0])
        if inner[0] == 0 and offsets[at] < lo:  # goes on from the piece before: its first line is the empty rest there
            number[row == 0] += seen[at] - 1
        seen = {int(rows[-1]): int(number[-1]) + 1}
        full = ~_BLANK[part] & (part != 10)
        counts = np.concatenate(([0], np.cumsum(full)))
        keep = counts[ends] > counts[starts]
        starts, ends, row, number = starts[keep], ends[keep], row[keep], number[keep]
        places = np.flatnonzero(full)
        starts, ends = places[counts[starts]], places[counts[ends] - 1] + 1
        found.append((mix(span_hash(prefix_hash(BYTE_A[part]), starts, ends)), number, rows[row]))
    hashes, number, row = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, number, row, np.searchsorted(row, np.arange(len(offsets)))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
