"""Token ids in Parquet: written in order of the document ids, read back selectively.

Documents are range-partitioned by id, so that files in the order of their names hold ascending ids.
A row has the id, where its tokens begin within the file, their number and the list of ids.  The
list is dictionary-encoded (a vocabulary fits one dictionary page); the other columns are
delta-encoded.  Row groups and pages are small enough for the page index to skip most of a file when
a few documents are read, and reading the other columns alone touches no token.  The start of a
file within the whole is the sum over the files before, one row each.

Encoding splits a slice of texts at ASCII white space, which this kind of vocabulary drops, and
encodes each different piece once with the tokenizers library; a bounded cache of packed arrays keeps
what a worker has encoded.  Pieces are told apart by 64-bit hashes.  Workers live on from task to task;
after each batch they give back to the system what numpy and Arrow have freed, which is most of it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanescope.llm import arrays
from lanescope.llm.shared import release

#: A worker forgets the pieces it knows beyond so many, or so many ids of them.
CACHE_ENTRIES, CACHE_IDS = 3_000_000, 16_000_000
END_ID = 2
#: Bytes of text per file, at most about, where ids are evenly spread; files grow in number instead.
RANGE_BYTES = 128_000_000

#: How files are written; each may be changed by the caller.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_file": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("file", T.IntegerType()),
    T.StructField("start_in_file", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])


class IdLists:
    """Lists of ids by 64-bit keys: about 30 bytes for a short list, found many at a time.

    A small sorted array takes new keys and is merged into a large one when it has grown.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.large, self.small = none, none
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids begin, and how many there are; -1 for a key that isn't there."""
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, starts, sizes in (self.large, self.small):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                begin[same], size[same] = starts[at[same]], sizes[at[same]]
        return begin, size

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes in new lists, laid end to end in ``ids``; returns where each begins."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), np.int32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.small = _merged(self.small, (keys, begin, sizes.astype(np.int32)))
        if len(self.small[0]) > 50_000 + len(self.large[0]) // 4:
            self.large, self.small = _merged(self.large, self.small), tuple(x[:0] for x in self.small)
        return begin


def _merged(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(a, b)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


class WordEncoder:
    """Encodes slices of texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = IdLists()

    def _lists(self, keys: np.ndarray, pieces: Callable[[np.ndarray], list[str]]):
        """Where the ids of each key begin in ``known.ids``, and how many; encodes what is new."""
        if len(self.known) > CACHE_ENTRIES or self.known.used > CACHE_IDS:
            self.known.clear()
        begin, size = self.known.find(keys)
        new = np.flatnonzero(size < 0)
        found = self.tokenizer.encode_batch_fast(pieces(new), add_special_tokens=False)
        lists = [x.ids for x in found]
        size[new] = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(size[new].sum()))
        begin[new] = self.known.add(keys[new], size[new], ids)
        return begin, size

    def encode(
        self, body: np.ndarray, offsets: np.ndarray, end: int = END_ID
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and where each text's begin."""
        starts, ends, first = arrays.word_bounds(body, offsets, arrays.SPACES)
        hashes = arrays.word_hashes(body, starts, ends)
        chosen, places = arrays.distinct(hashes)
        data = body.tobytes()

        def pieces(new: np.ndarray) -> list[str]:
            at = chosen[new]
            return [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]

        begin, size = self._lists(hashes[chosen], pieces)
        each = size[places]
        ids = self.known.ids[arrays.ranges(begin[places], each)]
        at = np.concatenate([[0], np.cumsum(each)])[first]
        return np.insert(ids, at[1:], end), at + np.arange(len(at))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that is free goes back to the system after each."""
    for batch in batches:
        yield batch
        del batch
        release()


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, start, file = encoder(path), 0, TaskContext.get().partitionId()
        for batch in arrays.pieces(_released(batches), "text"):
            ids, first = own.encode(*arrays.text_bytes(batch.column("text")), end)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.full(rows, file, np.int32)),
                    pa.array(start + first[:-1], pa.int64()), pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())),
                ],
                names=SCHEMA.names,
            )
            start += int(first[-1])

    return run


def _ranges(rows: DataFrame) -> int | None:
    """Ranges of RANGE_BYTES of text; None where the session's own number of partitions is enough."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // RANGE_BYTES)
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges if ranges > own else None


def write(
    docs: DataFrame, vocabulary: str, path: str, text: str = "text", id_column: str = "doc_id",
    end: int = END_ID, layout: dict[str, str] | None = None,
) -> None:
    """Encodes ``docs`` and writes them to ``path`` in ascending order of their ids.

    Null ids come first; rows that share an id are in order of a hash of their texts.  A null text
    counts as empty, and an empty text has the end id alone.  An empty table writes a folder
    without rows.  Other columns are left out.  ``vocabulary`` names the file, read by every worker.
    """
    order = ("doc_id", "__tie")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("__tie", F.xxhash64("text"))
    ranges = _ranges(rows)
    ordered = (
        (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    encoded = ordered.mapInArrow(_encode(vocabulary, end), SCHEMA)
    encoded.write.options(**{**LAYOUT, **(layout or {})}).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the files with ``start``, the number of ids of all documents before.

    Without ``ids`` among ``columns``, no token is read.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    files = stored.groupBy("file").agg(F.max(F.col("start_in_file") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = columns or ("doc_id", "start", "n_tokens", "ids")
    # One row of two numbers for each file: the lists of ids stay where they are.
    return stored.join(F.broadcast(files), "file").withColumn(
        "start", F.col("start_in_file") + F.col("before")
    ).select(*names)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _released(batches):
        ids = batch.column("ids")
        values = ids.flatten().to_numpy().astype("<i4", copy=False)  # the same bytes as unsigned
        at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        at = at.tolist()
        digests = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"),
             pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back, all from the lists themselves."""
    kept = tokens.select("doc_id", "start", "ids")
    return kept.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
