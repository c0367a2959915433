"""Source divergence audit by chunk factorization.

Whitespace chunks are counted per document and added up inside the task, so that what moves is one
row per task, source and chunk.  Every globally distinct chunk is tokenized once and its terms are
joined back.  How many documents hold a term needs no list of documents: a state of (documents up to
three, least and greatest document) is closed under union, as a union of at most two documents is
known from its least and greatest.

The pair part sums over all kept terms for every two sources of a language.  Blocks of terms become
dense tables inside a task, tiles of ``TILE`` sources wide, and leave it as one sum per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanescope.llm import arrays
from lanescope.llm.shared import written

#: A term: anything but ASCII characters that are no letters; A-Z are in lower case by then.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Counted chunks a task holds before it sends them on, and states united at a time.
HELD, UNITED = 1_000_000, 200_000
#: Sources in one tile, and counts in one block of a tile, about.
TILE, BLOCK = 256, 500_000
#: Cells of a dense table.
CELLS = 1 << 19

STATE = ["n", "docs", "first", "last"]
LETTER = ~arrays._separators((0x00, 0x60), (0x7B, 0x7F))
#: Counts of one task fit 32 bits.
HELD_SCHEMA = pa.schema([
    ("chunk", pa.large_binary()), ("hash", pa.uint64()), ("group", pa.int32()), ("n", pa.int32()),
    ("docs", pa.int32()), ("first", pa.int64()), ("last", pa.int64()),
])


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


TEXT, LONG, INT, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
CHUNKS = _struct(lang=TEXT, source=TEXT, chunk=TEXT, n=LONG, docs=LONG, first=LONG, last=LONG)
STATES = _struct(lang=TEXT, term=TEXT, source=TEXT, n=LONG, docs=LONG, first=LONG, last=LONG)
KEPT = _struct(lang=TEXT, term=TEXT, source=TEXT, n=LONG, number=LONG, total=LONG, head=BOOL)
SUMS = _struct(lang=TEXT, a=INT, b=INT, terms=LONG, value=LONG)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted rows."""
    fresh = np.ones(len(keys[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return np.flatnonzero(fresh)


class _Groups:
    """Numbers for the pairs (lang, source) that a task meets."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, str], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        return np.array([self.numbers.setdefault(p, len(self.numbers)) for p in pairs], np.int64)

    def names(self, numbers: np.ndarray) -> list[pa.Array]:
        at = pa.array(numbers)
        return [pa.array([p[i] for p in self.numbers], pa.string()).take(at) for i in (0, 1)]


def _counted(piece: pa.RecordBatch, group: np.ndarray) -> pa.Table:
    """Chunks of one slice by group: occurrences, documents, the least and greatest document."""
    body, offsets = arrays.text_bytes(piece.column("text"))
    body = arrays.lower(body)
    starts, ends, first = arrays.word_bounds(body, offsets, arrays.SPACES)
    of = np.repeat(np.arange(len(group)), np.diff(first))
    letters = np.concatenate([[0], np.cumsum(LETTER[body])])
    named = letters[ends] > letters[starts]  # a chunk without letters has no terms
    starts, ends, of = starts[named], ends[named], of[named]
    hashes = arrays.word_hashes(body, starts, ends)
    # Documents in order of their group, so that equal chunks of a group are neighbours.
    place = np.empty(len(group), np.int64)
    by_group = np.argsort(group, kind="stable")
    place[by_group] = np.arange(len(group))
    of = place[of]
    order = np.lexsort((of, hashes))
    hashes, doc = hashes[order], by_group[of[order]]
    own = group[doc]
    begin = _runs(hashes, doc)
    size = np.diff(np.append(begin, len(hashes)))  # occurrences in one document
    hashes, doc, own, at = hashes[begin], doc[begin], own[begin], order[begin]
    begin = _runs(hashes, own)
    if not len(begin):
        return HELD_SCHEMA.empty_table()
    rows = piece.column("row").to_numpy()[doc]
    at = at[begin]
    lengths = ends[at] - starts[at]
    chunk = pa.Array.from_buffers(pa.large_binary(), len(at), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)),
        pa.py_buffer(body[arrays.ranges(starts[at], lengths)].tobytes()),
    ])
    return pa.table([
        chunk, hashes[begin], own[begin].astype(np.int32),
        np.add.reduceat(size, begin).astype(np.int32),
        np.diff(np.append(begin, len(hashes))).astype(np.int32),
        np.minimum.reduceat(rows, begin), np.maximum.reduceat(rows, begin),
    ], schema=HELD_SCHEMA)


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same chunk and group added; no document is in two of the tables."""
    table = pa.concat_tables(tables).combine_chunks()
    hashes, group = table.column("hash").to_numpy(), table.column("group").to_numpy()
    order = np.lexsort((group, hashes))
    begin = _runs(hashes[order], group[order])
    found = {"chunk": table.column("chunk").take(pa.array(order[begin])),
             "hash": hashes[order[begin]], "group": group[order[begin]]}
    how = {"n": np.add, "docs": np.add, "first": np.minimum, "last": np.maximum}
    for name, merge in how.items():
        found[name] = merge.reduceat(table.column(name).to_numpy()[order], begin)
    return pa.table(found, schema=HELD_SCHEMA)


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, held, rows, merged = _Groups(), [], 0, 0

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, source = groups.names(table.column("group").to_numpy())
        whole = pa.table({
            "lang": lang, "source": source, "chunk": table.column("chunk").cast(pa.large_string()).cast(pa.string()),
            **{name: table.column(name).cast(pa.int64()) for name in STATE},
        })
        yield from whole.combine_chunks().to_batches(max_chunksize=65_536)

    for piece in arrays.pieces(batches, "text"):
        table = _counted(piece, groups.of(piece))
        if not len(table):
            continue
        held.append(table)
        rows += len(table)
        if rows < merged + HELD:
            continue
        held = [_merged(held)]
        rows = merged = len(held[0])
        if rows > HELD:
            yield from sent(held[0])
            held, rows, merged = [], 0, 0
    if held:
        yield from sent(_merged(held))


def chunk_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, chunk) with occurrences, number of documents, least and greatest document."""
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
          for c, n in ((text, "text"), (lang, "lang"), (source, "source"))],
        F.monotonically_increasing_id().alias("row"),
    )
    return texts.mapInArrow(_count_chunks, CHUNKS).repartition("chunk").groupBy(
        "chunk", "lang", "source"
    ).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("first").alias("first"),
          F.max("last").alias("last"))


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk, term, times): terms of each distinct chunk; a chunk without terms has no row.

    The condition, which always holds, needs every column: the plan below is then the same as that
    of ``chunks``, and Spark reuses its shuffle.
    """
    once = chunks.groupBy("chunk").agg(
        *[F.max(c).alias(c) for c in STATE], F.count("lang").alias("langs"), F.count("source").alias("sources")
    ).where("least(n, docs, langs, sources) > 0 AND last >= first")
    return once.select(
        "chunk", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term")
    ).groupBy("chunk", "term").agg(F.count("*").alias("times"))


def _reduced(state: dict[str, np.ndarray], begin: np.ndarray) -> dict[str, np.ndarray]:
    """States of each run united: two documents at most are told by their ids, more are three."""
    if not len(begin):
        return state
    first, last = np.minimum.reduceat(state["first"], begin), np.maximum.reduceat(state["last"], begin)
    size = np.diff(np.append(begin, len(state["n"])))
    low, high = np.repeat(first, size), np.repeat(last, size)
    other = np.zeros(len(low), bool)
    for ids in (state["first"], state["last"]):
        other |= (ids != low) & (ids != high)
    docs = 1 + (first != last) + np.logical_or.reduceat(other, begin)
    docs = np.where(np.maximum.reduceat(state["docs"], begin) > 2, 3, docs)
    return {"n": np.add.reduceat(state["n"], begin), "docs": docs.astype(np.int64),
            "first": first, "last": last}


def _fresh(column: pa.Array) -> np.ndarray:
    """Whether each text differs from the one before."""
    fresh = np.ones(len(column), bool)
    if len(column) > 1:
        fresh[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(
            zero_copy_only=False
        )
    return fresh


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in _and_none(batches):
        held += [] if batch is None else [batch]
        if held and (batch is None or sum(b.num_rows for b in held) >= rows):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the same term and source united, UNITED at a time, before they move."""
    for batch in _gathered(batches, UNITED):
        keys = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "source", "term")]
        order = np.lexsort(keys)
        begin = _runs(*[key[order] for key in keys])
        state = _reduced({c: batch.column(c).to_numpy()[order] for c in STATE}, begin)
        at = pa.array(order[begin])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in ("lang", "term", "source")]
            + [pa.array(state[c]) for c in STATE], names=STATES.names,
        )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted states to the counts of kept terms; a term's last sources wait for the next batch."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: pa.Table | None = None

    def reduced(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        lang, term, source = (table.column(c).chunk(0) for c in ("lang", "term", "source"))
        of_term = _fresh(lang) | _fresh(term)
        begin = np.flatnonzero(of_term | _fresh(source))
        state = _reduced({c: table.column(c).to_numpy() for c in STATE}, begin)
        at = pa.array(begin)
        return pa.table({
            "lang": lang.take(at), "term": term.take(at), "source": source.take(at), **state,
        }), np.flatnonzero(of_term[begin])

    def kept(table: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        size = np.diff(np.append(begin, len(table)))
        docs = np.add.reduceat(table.column("docs").to_numpy(), begin)
        stays = docs >= MIN_DOCS
        n = table.column("n").to_numpy()
        head = np.zeros(len(table), bool)
        head[begin] = True
        whole = pa.table({
            **{c: table.column(c) for c in ("lang", "term", "source", "n")},
            "number": np.repeat(number + np.cumsum(stays) - 1, size),
            "total": np.repeat(np.add.reduceat(n, begin), size), "head": head,
        }).filter(pa.array(np.repeat(stays, size)))
        number += int(stays.sum())
        return whole.combine_chunks()

    for batch in _and_none(batches):
        table = held if batch is None else pa.Table.from_batches([batch])
        if batch is not None and held is not None:
            table = pa.concat_tables([held, table])
        if table is None or not len(table):
            continue
        table, begin = reduced(table.combine_chunks())
        cut = len(table) if batch is None else int(begin[-1])
        held = table.slice(cut).combine_chunks()
        if cut:
            yield from kept(table.slice(0, cut), begin[begin < cut]).to_batches()


def _and_none(batches):
    yield from batches
    yield None


def kept_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, term, source, n) of terms in three documents of their language, written.

    ``number`` tells terms apart, ``total`` counts the language's occurrences, ``head`` marks one
    row of each term.
    """
    chunks = chunk_counts(docs, text, lang, source)
    states = chunks.join(tokenized(chunks), "chunk").select(
        "lang", "term", "source", (F.col("n") * F.col("times")).alias("n"), "docs", "first", "last"
    ).mapInArrow(_combine, STATES)
    return written(
        states.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
        .mapInArrow(_keep, KEPT)
    )


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + V)), exact beyond long integers."""
    return F.expr(
        f"1L + (CAST({SCALE} AS DECIMAL(19,0)) * CAST({count} + 1 AS DECIMAL(18,0))) "
        f"div CAST({total} + v AS DECIMAL(18,0))"
    )


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _groups(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """Each occurring (lang, source): its number and tile, N, the language's V and N, written."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
             for c, n in ((lang, "lang"), (source, "source"))]
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("cells"))
    # The aggregation of ``kept`` by language is a row per language.
    whole = kept.groupBy("lang").agg(
        F.count_if("head").alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("lang_cells")
    )
    numbered = Window.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("long")
    groups = (
        docs.select(*named).distinct()
        .join(own, ["lang", "source"], "left").join(whole, "lang", "left")
        .select(
            "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("own_n", "v", "lang_n", "lang_cells")],
            (F.row_number().over(numbered) - 1).alias("no"),
            F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        )
    )
    return written(groups.select(
        "*", F.when(F.col("v") > 0, _share("0", "own_n")).alias("base"),
        F.floor(F.col("no") / TILE).cast("int").alias("tile"),
        F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"),
        (1 + F.floor(F.col("lang_cells") / BLOCK)).cast("int").alias("blocks"),
    ))


def _pair_sums(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Sum over the terms of one block for every two sources of two tiles, in both directions."""
    empty = pa.table([pa.array([], f) for f in (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())],
                     names=SUMS.names)
    if not len(cells) or not len(sources):
        return empty
    no, tile = sources.column("seat").to_numpy(), sources.column("tile").to_numpy()
    base = sources.column("base").to_numpy()
    place = np.searchsorted(np.sort(no), cells.column("no").to_numpy())
    order = np.argsort(no)
    no, tile, base = no[order], tile[order], base[order]
    terms, row = np.unique(cells.column("number").to_numpy(), return_inverse=True)
    p = cells.column("p").to_numpy()
    by_row = np.argsort(row, kind="stable")
    row, place, p = row[by_row], place[by_row], p[by_row]
    left, right = sources.column("ta")[0].as_py(), sources.column("tb")[0].as_py()
    in_left, in_right = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    both = [(in_left, in_right)] if left == right else [(in_left, in_right), (in_right, in_left)]
    sums = np.zeros((len(no), len(no)), np.int64)
    step = max(1, CELLS // len(no))
    for at in range(0, len(terms), step):
        rows = min(step, len(terms) - at)
        table = np.broadcast_to(base, (rows, len(no))).copy()
        a, b = np.searchsorted(row, [at, at + rows])
        table[row[a:b] - at, place[a:b]] = p[a:b]
        for ours, theirs in both:
            q = table[:, theirs]
            for s in ours:
                apart = table[:, s, None] - q
                sums[s, theirs] += (apart * apart // q).sum(axis=0)
    found = [np.meshgrid(x, y, indexing="ij") for x, y in both]
    a, b = (np.concatenate([pair[i].ravel() for pair in found]) for i in (0, 1))
    return pa.table({
        "lang": pa.array([cells.column("lang")[0].as_py()] * len(a), pa.string()),
        "a": no[a].astype(np.int32), "b": no[b].astype(np.int32),
        "terms": np.full(len(a), len(terms)), "value": sums[a, b],
    }).filter(pa.array(a != b))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    keys = ["lang", "ta", "tb", "block"]

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows sent to every two tiles that hold theirs."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        return rows.withColumn("other", other).withColumns({
            "ta": F.least("tile", "other"), "tb": F.greatest("tile", "other"),
        })

    left = dealt(cells.withColumn("block", F.pmod("number", "blocks").cast("int"))).select(
        *keys, "number", "no", "p"
    )
    right = dealt(groups.where("v > 0")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(*[F.col(c).alias(c) for c in keys], F.col("no").alias("seat"), F.col("tile").alias("tile"),
             F.col("base").alias("base"))
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_sums, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(
        F.sum("terms").alias("terms"), F.sum("value").alias("value")
    )
    ours = groups.select("lang", "source", "v", F.col("no").alias("a"), F.col("base").alias("p"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"),
                           F.col("base").alias("q"))
    zero = F.lit(0).cast("long")
    # A term in neither source of a pair of tiles was left out; it has the base share in both.
    absent = (F.col("v") - F.coalesce("terms", zero)) * F.coalesce(_divergence("p", "q"), zero)
    return ours.join(theirs, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.coalesce("value", zero) + absent).alias("value"),
    )


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources of a language differ in their terms.

    Terms are runs of letters (every character beyond ASCII counts as one), A-Z in lower case.  A
    language keeps the terms that occur in at least three of its documents; each row of ``docs`` is
    a document, also where an id or a whole row repeats.  Null texts, languages and sources are
    empty strings.  Every occurring (lang, source) takes part, without terms too.

    Shares are p = 1 + floor(10^9 (count + 1) / (N + V)) of a source and q likewise of the other
    source (part ``pair``) or the language (part ``term``); the value is floor((p - q)^2 / q), for
    pairs the sum of it over all kept terms, 0 if there are none.  Part ``term`` has the 200 first
    terms with p > q of each source that occur there.  Equal values are ranked by item.  No
    documents give no rows; other columns are ignored.
    """
    kept = kept_terms(docs, text, lang, source)
    groups = _groups(docs, kept, lang, source)
    cells = kept.join(groups, ["lang", "source"]).withColumns({
        "p": _share("n", "own_n"), "q": _share("total", "lang_n"),
    })
    terms = cells.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _divergence("p", "q").alias("value"),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return (
        _pairs(cells, groups).withColumn("rank", ranked).select(*names)
        .unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= TOP).select(*names))
    )
