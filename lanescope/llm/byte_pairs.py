"""Byte-level BPE encoding and decoding by a rank file, in ``mapInArrow`` tasks.

Pre-tokens come from the array scan in ``pretokens``.  Within a slice of texts each different
pre-token is encoded once: pair merging is cached per Python worker, in a cache that is emptied
when it holds ``CACHE_ENTRIES``.  Ids, byte offsets of tokens and decoded bytes are gathered by array
arithmetic.  No row leaves its partition, so no key can be hot, and memory is bounded by the slice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lanescope.llm import arrays, pretokens
from lanescope.llm.shared import released

CACHE_ENTRIES = 120_000
#: Longer pre-tokens are merged with a heap instead of repeated passes.
LONG_PIECE = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of pairs over a linked list of parts."""
    import heapq

    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int, int] | None:
        j = after[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : end[j]])
        return None if rank is None else (rank, i, end[i], end[j])

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, middle, to = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != middle or j >= n or end[j] != to:
            continue  # one of its parts has been joined since
        alive[j], end[i], after[i] = False, to, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (found := pair(k)):
                heapq.heappush(heap, found)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes and decodes slices of texts; one per worker process and vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cache: dict[bytes, np.ndarray] = {}
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.zeros(int(self.lengths.sum()), np.uint8)
        for token, rank in ranks.items():
            at = self.starts[rank]
            self.bytes[at : at + len(token)] = np.frombuffer(token, np.uint8)

    def _ids(self, piece: bytes) -> np.ndarray:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            found = np.array(merge(piece, self.ranks), np.uint32)
            if len(piece) <= LONG_PIECE:
                self.cache[piece] = found
        return found

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        starts = pretokens.token_starts(body, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(body))
        chosen, places = arrays.distinct(arrays.word_hashes(body, starts, ends))
        data = body.tobytes()
        own = [self._ids(data[a:b]) for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        begin = np.cumsum(sizes) - sizes
        each = sizes[places]
        ids = np.concatenate(own)[arrays.ranges(begin[places], each)]
        ends_of = np.concatenate([[0], np.cumsum(each)])
        return ids, ends_of[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after another."""
        return self.bytes[arrays.ranges(self.starts[ids], self.lengths[ids])]

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes end in the decoded text."""
        return np.cumsum(self.lengths[ids])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("token_ends", T.ArrayType(T.IntegerType())),
])
DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _apply(docs: DataFrame, path: str, text: str, keep, added: T.StructType, make) -> DataFrame:
    names = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    frame = docs.select(*dict.fromkeys([*names, text]))
    schema = T.StructType([frame.schema[c] for c in names] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in arrays.pieces(released(batches), text):
            body, offsets = arrays.text_bytes(batch.column(text))
            ids, first = own.encode(body, offsets)
            columns = [batch.column(c) for c in names] + make(own, ids, first)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def encode(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, ids and token_ends.

    ``token_ends`` are the byte offsets in the UTF-8 text where tokens end.  ``path`` names the rank
    file; every worker reads it.  A null text counts as empty, and an empty text has empty lists.
    Columns that clash with the new ones are replaced; ``text`` may be among ``keep``.
    """

    def make(own: Encoder, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        ends = own.byte_ends(ids)
        base = np.concatenate([[0], ends])[first[:-1]]
        ends = ends - np.repeat(base, np.diff(first))
        return [
            pa.array(np.diff(first), pa.int64()),
            _lists(ids.astype(np.int32), first, pa.int32()),
            _lists(ends.astype(np.int32), first, pa.int32()),
        ]

    return _apply(docs, path, text, keep, ENCODED, make)


#: Tokens that are decoded in one step.
DECODED_AT_ONCE = 500_000


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``to``: the bytes of the list ``ids``.

    A null list counts as empty.  A column named ``to`` is replaced.
    """
    names = [c for c in encoded.columns if c != to]
    schema = T.StructType([encoded.schema[c] for c in names]).add(to, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in released(batches):
            column = batch.column(ids)
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            values, made, row = column.flatten().to_numpy(zero_copy_only=False), [], 0
            while row < batch.num_rows:
                to_row = int(np.searchsorted(first, first[row] + DECODED_AT_ONCE, side="right")) - 1
                to_row = min(max(to_row, row + 1), batch.num_rows)
                part = values[first[row] : first[to_row]]
                data = own.decode(part).tobytes()
                ends = np.concatenate([[0], own.byte_ends(part)])[first[row : to_row + 1] - first[row]].tolist()
                made += [data[x:y] for x, y in zip(ends, ends[1:])]
                row = to_row
            columns = [batch.column(c) for c in names] + [pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return encoded.select(*names).mapInArrow(run, schema)


def digests(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (or ``keep``) with n_tokens, and SHA-256 of the ids and of the decoded bytes.

    Ids are digested as little-endian unsigned 32-bit integers.  Nulls and clashes: as ``encode``.
    """

    def make(own: Encoder, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        ids = ids.astype("<u4")
        back = own.decode(ids)
        ends = np.concatenate([[0], own.byte_ends(ids)])[first].tolist()
        at = first.tolist()
        return [
            pa.array(np.diff(first), pa.int64()),
            pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
            pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
        ]

    return _apply(docs, path, text, keep, DIGESTS, make)
