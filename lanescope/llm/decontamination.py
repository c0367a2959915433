"""Benchmark decontamination by suffix arrays of the training texts.

A task cuts its documents into shards of about two million words at most and builds the suffix array
of each: word ranks are doubled, and one sort of numbers (rank, rank further on, position) per
doubling orders all suffixes.  Every suffix of every benchmark item is then binary-searched in
every shard, word by word, until its range of equal suffixes is empty.  The range at the depth of
a window lists each place where the window occurs; runs of such places are the longest verbatim
matches.

Nothing is shuffled.  The benchmark is broadcast in blocks whose words are counted first
(``BLOCK_WORDS``); a larger benchmark takes several passes of the same stage, each adding its hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanescope.llm import arrays
from lanescope.llm.shared import released, written

WINDOW = 10
#: Positions in a shard are 21 bits of the sorted numbers, as are both ranks.
POSITION_BITS = 21
SHARD_WORDS = 1_200_000
#: Words of benchmark in one broadcast; about 16 MB with what is derived from them.
BLOCK_WORDS = 500_000
#: An item of more words is searched in parts that overlap by all but one word of a window.
PART_WORDS = 4096

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("item_word", T.LongType()),
    T.StructField("doc_word", T.LongType()),
    T.StructField("n_words", T.LongType()),
]))
_MATCH_TYPE = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("item_word", pa.int64()),
    ("doc_word", pa.int64()), ("n_words", pa.int64()),
]))
STATE = "__decontamination"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and at which word each text begins."""
    body, offsets = arrays.text_bytes(column)
    body = arrays.lower(body)
    starts, ends, first = arrays.word_bounds(body, offsets, arrays.SYMBOLS)
    return arrays.word_hashes(body, starts, ends), first


class SuffixArray:
    """Suffixes of a sequence of word hashes, in the order of their first ``depth`` words."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int) -> None:
        """A gap after each text, which equals no word, keeps matches inside texts."""
        texts = len(first) - 1
        self.first = first + np.arange(texts + 1)  # where texts begin once gaps are put in
        n = len(hashes) + texts
        assert n < 1 << POSITION_BITS or texts == 1, "a shard has too many words"
        self.known, ranks = np.unique(hashes, return_inverse=True) if n < 1000 else _ranked(hashes)
        self.words = np.zeros(n, np.int64)
        gaps = self.first[1:] - 1
        inside = np.ones(n, bool)
        inside[gaps] = False
        self.words[inside] = ranks + 1
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        n, ranks, reach = len(self.words), self.words, 1
        if n >= 1 << POSITION_BITS:
            return self._sorted_slowly(depth)
        bits, low = np.uint64(POSITION_BITS), np.uint64((1 << POSITION_BITS) - 1)
        place = np.arange(n, dtype=np.uint64)
        while True:
            further = np.zeros(n, np.uint64)
            further[: n - reach] = ranks[reach:].astype(np.uint64) + np.uint64(1)
            keys = (((ranks.astype(np.uint64) << bits) | further) << bits) | place
            keys.sort()
            order = (keys & low).astype(np.int64)
            reach *= 2
            pairs = keys >> bits
            fresh = np.zeros(n, np.int64)
            fresh[1:] = pairs[1:] != pairs[:-1]
            np.cumsum(fresh, out=fresh)
            if reach >= depth or n == 0 or fresh[-1] == n - 1:
                return order
            ranks = np.empty(n, np.int64)
            ranks[order] = fresh

    def _sorted_slowly(self, depth: int) -> np.ndarray:
        """The same for one text with more words than a shard."""
        n, ranks, reach = len(self.words), self.words, 1
        while True:
            further = np.zeros(n, np.int64)
            further[: n - reach] = ranks[reach:] + 1
            order = np.lexsort((further, ranks))
            reach *= 2
            fresh = np.zeros(n, np.int64)
            a, b = ranks[order], further[order]
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            np.cumsum(fresh, out=fresh)
            if reach >= depth or fresh[-1] == n - 1:
                return order
            ranks = np.empty(n, np.int64)
            ranks[order] = fresh

    def ranks_of(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word in this shard; -1 if it doesn't occur."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, -1)

    def _bound(self, low, high, depth, wanted, after: bool) -> np.ndarray:
        """First place in [low, high) whose word at ``depth`` is not below (or is above) wanted."""
        low, high = low.copy(), high.copy()
        n = len(self.words)
        while (low < high).any():
            middle = (low + high) // 2
            at = self.order[np.minimum(middle, n - 1)] + depth
            there = np.where(at < n, self.words[np.minimum(at, n - 1)], -1)
            less = (there <= wanted) if after else (there < wanted)
            less &= low < high
            high = np.where(less, high, np.minimum(middle, high))
            low = np.where(less, middle + 1, low)
        return low

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the test words, the range of suffixes here that begin with its window.

        ``lengths``: words of that window, 0 where the suffix has none.
        """
        m = len(words)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.words), np.int64)
        low_at, high_at = np.zeros(m, np.int64), np.zeros(m, np.int64)
        live, depth = np.flatnonzero(lengths > 0), 0
        while len(live):
            live = live[words[live + depth] >= 0]
            wanted = words[live + depth]
            from_, to = low[live], high[live]
            low[live] = self._bound(from_, to, depth, wanted, False)
            high[live] = self._bound(from_, to, depth, wanted, True)
            depth += 1
            live = live[low[live] < high[live]]
            done = live[lengths[live] == depth]
            low_at[done], high_at[done] = low[done], high[done]
            live = live[lengths[live] > depth]
        return low_at, high_at


def _ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the rank of each."""
    chosen, places = arrays.distinct(hashes)
    known = hashes[chosen]
    if (known[1:] > known[:-1]).all():
        return known, places
    known, ranks = np.unique(known, return_inverse=True)
    return known, ranks[places]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[np.ndarray, list]], bool]]:
    """The benchmark's items in blocks of bounded size: word hashes, and the ids that have them.

    One block is read at a time, when it is asked for; the flag says whether it is the last one.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("text")
        .agg(F.collect_list(F.struct("item_id")).alias("ids"))
    )
    size = items.agg(F.sum(F.octet_length("text") + 8 * F.size("ids")).alias("n")).first().n or 0
    # A word and the sign after it have two bytes at least.
    n_blocks = size // (2 * BLOCK_WORDS) + 1
    for number in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == number)
        table = mine.toArrow().combine_chunks()
        block: dict[bytes, tuple] = {}
        if table.num_rows:
            hashes, first = words_of(table.column("text").combine_chunks())
            for row, ids in enumerate(table.column("ids").to_pylist()):
                own = hashes[first[row] : first[row + 1]]
                if len(own):
                    block.setdefault(own.tobytes(), (own, []))[1].extend(x["item_id"] for x in ids)
        yield list(block.values()), number == n_blocks - 1


def _parts(block: list, window: int) -> tuple[np.ndarray, ...]:
    """Test words of all items one after another, and what each suffix belongs to."""
    words, item, at, lengths = [], [], [], []
    for number, (own, _) in enumerate(block):
        step = PART_WORDS - window + 1
        for start in range(0, max(1, len(own) - window + 1), step):
            part = own[start : start + PART_WORDS]
            span = min(window, len(part))
            words.append(part)
            item.append(np.full(len(part), number))
            at.append(start + np.arange(len(part)))
            lengths.append(np.where(np.arange(len(part)) <= len(part) - span, span, 0))
    if not words:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in (words, item, at, lengths))


def _shard_hits(array: SuffixArray, test: tuple) -> tuple[np.ndarray, ...] | None:
    """Runs of window occurrences: text, first word, words, item number, first word in the item."""
    words, item, at, lengths = test
    low, high = array.search(array.ranks_of(words), lengths)
    suffix = np.flatnonzero(high > low)
    each = (high - low)[suffix]
    place = array.order[arrays.ranges(low[suffix], each)]
    suffix = np.repeat(suffix, each)
    order = np.lexsort((place, place - at[suffix], item[suffix]))
    suffix, place = suffix[order], place[order]
    if not len(place):
        return None
    own, where = item[suffix], place - at[suffix]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1]) | (place[1:] > place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(place)) - 1
    text = np.searchsorted(array.first, place[begin], side="right") - 1
    first = place[begin] - array.first[text]
    return text, first, place[last] - place[begin] + lengths[suffix[last]], own[begin], at[suffix[begin]]


def _search(block_of: Broadcast, window: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_of.value
        test = _parts(block, window)
        depth = int(test[3].max()) if len(test[3]) else 1
        for batch in arrays.pieces(released(batches), column, 6_000_000):
            hashes, first = words_of(batch.column(column))
            spans = [[] for _ in range(batch.num_rows)]
            counts = np.diff(first)
            row = 0
            while row < batch.num_rows:
                limit = first[row] + SHARD_WORDS
                to = max(row + 1, int(np.searchsorted(first, limit, side="right")) - 1)
                to = min(to, batch.num_rows)
                own = hashes[first[row] : first[to]]
                if len(own) and len(test[0]):
                    array = SuffixArray(own, first[row : to + 1] - first[row], depth)
                    found = _shard_hits(array, test)
                    if found is not None:
                        for text, start, n, number, item_at in zip(*(x.tolist() for x in found)):
                            spans[row + text].extend(
                                (i, item_at, start, n) for i in block[number][1]
                            )
                row = to
            yield arrays.with_columns(batch, _added(batch, spans, counts))

    return run


def _added(batch: pa.RecordBatch, spans: list, counts: np.ndarray) -> dict[str, pa.Array]:
    if STATE in batch.schema.names:
        before = batch.column(STATE).to_pylist()
        spans = [
            [(m["item_id"], m["item_word"], m["doc_word"], m["n_words"]) for m in old] + new
            for old, new in zip(before, spans)
        ]
    names = ("item_id", "item_word", "doc_word", "n_words")
    matches = pa.array([[dict(zip(names, m)) for m in sorted(x, key=_order)] for x in spans], _MATCH_TYPE)
    return {STATE: matches, f"{STATE}_words": pa.array(counts, pa.int64())}


def _order(match) -> tuple:
    return match[2], match[0] is None, match[0] or 0, match[1]


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> DataFrame:
    """``docs`` with the matches of all blocks, one pass for each.

    A pass is written before the next block is read, and its broadcast goes with it, so that driver and
    executors hold one block; the last pass (in general the only one) stays lazy.
    """
    frame = docs
    for block, last in _blocks(benchmark):
        schema = T.StructType([f for f in frame.schema.fields if not f.name.startswith(STATE)])
        schema = schema.add(STATE, MATCHES).add(f"{STATE}_words", T.LongType())
        shared = docs.sparkSession.sparkContext.broadcast(block)
        frame = frame.mapInArrow(_search(shared, window, text), schema)
        if not last:
            frame = written(frame)
            shared.destroy()
    return frame


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with ``n_words`` and ``matches``.

    ``matches`` lists the longest verbatim matches of ``window`` words or more with any item of
    ``benchmark`` (item_id, text): item, its word, the document's word (both from 0), words.  An
    item of fewer words matches as a whole; an item without words never does.  A null text has no
    words.  Repeated documents and repeated items are each treated on their own; items whose id is
    null count as one item.  Columns that clash with the new ones are replaced; others stay.
    """
    names = [c for c in (keep or docs.columns) if c not in ("n_words", "matches")]
    frame = _searched(docs.select(*dict.fromkeys([*names, text])), benchmark, window, text)
    return frame.select(
        *names, F.col(f"{STATE}_words").alias("n_words"), F.col(STATE).alias("matches")
    )


def contamination(matched: DataFrame) -> DataFrame:
    """Digest of ``matches``: n_hit, n_items, items_sha256, contaminated in place of the list."""
    own = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item_id.cast("string"))))
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(
        m.doc_word.alias("a"), (m.doc_word + m.n_words).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct(
        (s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, s.to))).alias("n"),
        F.greatest(s.to, x.b).alias("to")), lambda s: s.n)
    return (
        matched.withColumns({"n_hit": covered, "__items": own})
        .withColumns({
            "n_items": F.size("__items").cast("long"),
            "items_sha256": F.sha2(F.array_join("__items", ","), 256),
            "contaminated": F.col("n_hit") > 0,
        })
        .drop("matches", "__items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark; columns as they were."""
    found = _searched(docs, benchmark, window, "text")
    return found.where(F.size(STATE) == 0).select(*docs.columns)
