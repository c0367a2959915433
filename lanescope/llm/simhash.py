"""SimHash near-duplicates over an inverted index of five of eight byte positions.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they
share at least ``MIN_SHARED`` = 5 bytes at equal positions.  The index lists fingerprints under each
choice of five byte positions and the bytes there: 56 postings a fingerprint, and one that any
linked pair has in common.  These choices replace a tally of shared bytes: lists by single bytes
would hold one in 256 of all fingerprints each.  Every pair in a list shares five bytes already, so
that ``shared_bytes`` drops none there; pairs are verified bit by bit.  Only the distinct
fingerprints are indexed, so copies cost nothing; a posting list leaves 24 bits open, so it has at
most 2^24 entries, whatever the input.  Long lists are searched breadth first and yield one edge per
member instead of all pairs.  A list of more than ``CUBE_FROM`` members fills a good part of the cube
of its 24 open bits, where least labels spread over links bit by bit: three steps along all 24 axes
reach what differs in three bits, so that time and memory depend on the cube, not on the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanescope.llm import arrays
from lanescope.llm.components import components
from lanescope.llm.shared import released, written

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Bits of the bytes that members of a list don't share.
OPEN_BITS = 8 * (8 - MIN_SHARED)
#: Lists up to this length have all their pairs examined at once.
SHORT_LIST = 32
#: Members of either side compared at a time, in long lists.
BLOCK, REST = 256, 1 << 14
#: Lists beyond this length are labelled on the cube of their open bits.
CUBE_FROM = 100_000
#: Rows of the index per partition, about; only the number of partitions depends on it.
ROWS_PER_PARTITION = 2_000_000

FINGERPRINT, ROW, NODE = "__fingerprint", "__row", "__node"


def _joined(body: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case with one space between words; bounds of words, first word per text."""
    body = arrays.lower(body)
    starts, ends, first = arrays.word_bounds(body, offsets, arrays.SPACES)
    keep = ~arrays.SPACES[body]
    gaps = ends[ends < len(body)]
    gaps = gaps[~keep[gaps]]
    body = body.copy()
    body[gaps] = 0x20
    keep[gaps] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return body[keep].tobytes(), at[starts], at[ends], first


def shingle_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, and where each text's begin."""
    data, starts, ends, first = _joined(body, offsets)
    words = np.diff(first)
    counts = np.maximum(words - SHINGLE + 1, np.minimum(words, 1))
    at = arrays.ranges(first[:-1], counts)
    last = np.minimum(at + SHINGLE, np.repeat(first[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist())),
        np.uint64, len(at),
    )
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def fingerprints(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: the bits set in over half of its shingles' hashes."""
    hashes, first = shingle_hashes(body, offsets)
    counts = np.diff(first)
    result = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return result
    # Eight counters of eight bits are summed in one number, over 255 hashes at most.
    blocks = -(-counts[filled] // 255)
    begin = np.repeat(first[filled], blocks) + 255 * arrays.ranges(np.zeros(len(filled), np.int64), blocks)
    of = np.cumsum(blocks) - blocks
    every = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & every, begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        ones = (2 * sums > counts[filled, None]).astype(np.uint64)
        for byte in range(8):
            result[filled] |= ones[:, byte] << np.uint64(8 * byte + bit)
    return result


def fingerprinted(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the fingerprint as a signed number."""
    frame = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([frame.schema[c] for c in keep]).add(FINGERPRINT, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(released(batches), text):
            found = fingerprints(*arrays.text_bytes(batch.column(text)))
            columns = [batch.column(c) for c in keep] + [pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema)


def _masks() -> list[int]:
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), MIN_SHARED)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _postings(prints: DataFrame) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in _masks()])
    return prints.select(NODE, F.posexplode(masks).alias("set", "mask")).select(
        F.col("set").cast("short").alias("set"),
        F.col(NODE).bitwiseAND(F.col("mask")).alias("part"), NODE,
    )


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of equal bytes at equal positions."""
    return (np.ascontiguousarray(a ^ b).view(np.uint8).reshape(*np.shape(a), 8) == 0).sum(axis=-1)


def _pairs_of_short(values: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """All verified pairs of short lists."""
    each = np.repeat(begin, size)
    rank = arrays.ranges(np.zeros(len(size), np.int64), size)
    left = np.repeat(each + rank, rank)
    right = arrays.ranges(each, rank)
    a, b = values[left], values[right]
    kept = np.flatnonzero(shared_bytes(a, b) >= MIN_SHARED)
    a, b = a[kept], b[kept]
    linked = np.bitwise_count(a ^ b) <= MAX_BITS
    return a[linked], b[linked]


def _stars_of_long(values: np.ndarray):
    """For each member of a list but the first of its kind: the first member it can reach."""
    left, roots, members = values, [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), BLOCK):
                rest = np.flatnonzero(~near)
                for some in range(0, len(rest), REST):
                    part = rest[some : some + REST]
                    apart = np.bitwise_count(left[part, None] ^ front[None, at : at + BLOCK])
                    near[part[(apart <= MAX_BITS).any(axis=1)]] = True
            front, left = left[near], left[~near]
            members.append(front)
            roots.append(np.full(len(front), root))
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (empty, empty)


def _dilated(labels: np.ndarray) -> np.ndarray:
    """The least label among each corner of the cube and those one bit away."""
    found = labels.copy()
    for bit in range(OPEN_BITS):
        old, new = (x.reshape(-1, 2, 1 << bit) for x in (labels, found))
        for side in (0, 1):
            np.minimum(new[:, side], old[:, 1 - side], out=new[:, side])
    return found


def _stars_on_cube(values: np.ndarray, number: int):
    """What ``_stars_of_long`` gives, for members of a list of set ``number``, in a bounded time."""
    open_bytes = [p for p in range(8) if p not in list(combinations(range(8), MIN_SHARED))[number]]
    corner = np.zeros(len(values), np.int64)
    for place, p in enumerate(open_bytes):
        corner |= ((values >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << 8 * place
    labels = np.full(1 << OPEN_BITS, 0xFFFFFFFF, np.uint32)
    root = np.arange(len(values), dtype=np.uint32)
    while True:
        labels[corner] = root
        near = labels
        for _ in range(MAX_BITS):
            near = _dilated(near)
        least = near[corner]
        while True:  # labels are members, whose own labels are at least as small
            further = least[least]
            if (further == least).all():
                break
            least = further
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted postings; the last list of a batch waits for what follows."""
    held = None
    for batch in _with_end(batches):
        rows = None if batch is None else [
            batch.column(0).to_numpy().astype(np.int64),
            batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64),
        ]
        if rows is None:
            rows, held = held, None
        elif held is not None:
            rows, held = [np.concatenate(x) for x in zip(held, rows)], None
        if rows is None or not len(rows[0]):
            continue
        sets, parts, values = rows
        fresh = np.ones(len(sets), bool)
        fresh[1:] = (sets[1:] != sets[:-1]) | (parts[1:] != parts[:-1])
        begin = np.flatnonzero(fresh)
        if batch is not None:
            held = [x[begin[-1] :] for x in rows]
            begin = begin[:-1]
            size = np.diff(np.append(begin, len(sets) - len(held[0])))
        else:
            size = np.diff(np.append(begin, len(sets)))
        short = (size > 1) & (size <= SHORT_LIST)
        found = [_pairs_of_short(values, begin[short], size[short])]
        for at, n in zip(begin[size > SHORT_LIST].tolist(), size[size > SHORT_LIST].tolist()):
            members = values[at : at + n]
            found.append(
                _stars_of_long(members) if n <= CUBE_FROM else _stars_on_cube(members, int(sets[at]))
            )
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column NODE) that connect all linked ones."""
    n = prints.count()
    partitions = max(
        int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        n * len(_masks()) // ROWS_PER_PARTITION,
    )
    return (
        _postings(prints)
        .repartition(partitions, "set", "part")
        .sortWithinPartitions("set", "part", NODE)
        .mapInArrow(_link, "a long, b long")
    )


def _classes(marked: DataFrame, order: list[str]) -> DataFrame:
    """Fingerprint to the least ``order`` (a struct) of its component."""
    prints = marked.groupBy(F.col(FINGERPRINT).alias(NODE)).agg(F.min(F.struct(*order)).alias("first"))
    prints = written(prints)
    found = components(links(prints)).withColumnRenamed("node", NODE)
    prints = prints.join(found, NODE, "left").withColumn(
        "component", F.coalesce("component", NODE)
    )
    least = prints.groupBy("component").agg(F.min("first").alias("first"))
    return prints.select(F.col(NODE).alias(FINGERPRINT), "component").join(least, "component").drop(
        "component"
    )


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc id, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case; shingles have three words, or all of a
    shorter text.  A text without words, or null, has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest id among documents reachable over links of at most three
    differing bits; rows with null ids get their component's smallest id, null if it has none.
    Repeated rows and ids are kept as they are.
    """
    marked = written(fingerprinted(docs, text, [id_column]).withColumnRenamed(id_column, "__id"))
    # An id that is null sorts behind all others.
    marked = marked.select("__id", FINGERPRINT, F.col("__id").isNull().alias("__none"))
    classes = _classes(marked, ["__none", "__id"])
    return marked.join(classes, FINGERPRINT).select(
        F.col("__id").alias(id_column),
        F.lower(F.lpad(F.hex(FINGERPRINT), 16, "0")).alias("fingerprint"),
        F.col("first").getField("__id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, any one row among its repeats."""
    names = docs.columns
    whole = fingerprinted(docs, text, names).withColumn(ROW, F.monotonically_increasing_id())
    whole = written(whole)  # from here on, row numbers are fixed
    marked = whole.select(
        F.col(id_column).alias("__id"), FINGERPRINT, ROW,
        F.col(id_column).isNull().alias("__none"),
    )
    kept = _classes(marked, ["__none", "__id", ROW]).select(
        F.col("first").getField(ROW).alias(ROW)
    ).distinct()
    return whole.join(kept, ROW, "left_semi").select(*names)
