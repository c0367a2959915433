"""Array helpers that the operators share: texts as byte arrays, words, hashes, distinct values.

All of them work on one Arrow batch, or a slice of it, inside a Spark task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at most (one longer text is taken alone).
PIECE_BYTES = 1_200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER.tobytes()


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes between words of ``[^\x20\x09-\x0D]+``.
SPACES = _separators((0x20, 0x20), (0x09, 0x0D))
#: Bytes between words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (texts are in lower case by then).
SYMBOLS = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have ``limit`` bytes at most, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), rows)
            yield batch.slice(at, to - at)
            at = to


def lower(body: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.frombuffer(body.tobytes().translate(LOWER), np.uint8)


def word_bounds(
    body: np.ndarray, offsets: np.ndarray, between: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and at which word each text begins (one more at the end)."""
    inside = ~between[body]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begin, close = offsets[:-1], offsets[1:]
    begin, close = begin[begin < close], close[begin < close] - 1
    starts[begin] = inside[begin]
    ends[close] = inside[close]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * _MIX[1]
        values = (values ^ (values >> np.uint64(27))) * _MIX[2]
        return values ^ (values >> np.uint64(31))


def eight_bytes(body: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven after it as one number; the first byte is lowest."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray((len(body) + 1,), "<u8", padded.data, strides=(1,))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice; equal bytes have equal hashes, wherever they are."""
    eight = eight_bytes(body)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        hashes = mix(lengths.astype(np.uint64) * _MIX[0] + np.uint64(1))
        left, at, rows = lengths, starts, None
        while True:
            part = eight[at] & _KEEP[np.minimum(left, 8)]
            if rows is None:
                hashes = mix((hashes ^ part) * _MIX[0])
            else:
                hashes[rows] = mix((hashes[rows] ^ part) * _MIX[0])
            more = left > 8
            if not more.any():
                return hashes
            rows = np.flatnonzero(more) if rows is None else rows[more]
            left, at = left[more] - 8, at[more] + 8


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each value, and for each value its place among those.

    One sort of numbers that hold the upper bits of the value and its position, since sorting
    numbers is several times faster than sorting positions by them.  Values that differ in their
    lower bits only may be listed more than once, which costs time, not correctness.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    order = (np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    there = hashes[order]
    fresh = np.ones(n, bool)
    fresh[1:] = there[1:] != there[:-1]
    places = np.empty(n, np.int64)
    places[order] = np.cumsum(fresh) - 1
    return order[fresh], places


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    skip = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return skip + np.arange(total)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    names = list(batch.schema.names)
    columns = dict(zip(names, batch.columns))
    columns.update(new)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
