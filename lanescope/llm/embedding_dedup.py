"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample of SAMPLE vectors (principal components, then alternating sign codes and
orthogonal Procrustes steps) so that the signs of a rotated vector are a balanced code of 64 bits.
The code is dealt into tables in ``DEALS`` ways, each cutting it into four substrings of 16 bits;
vectors that agree in a substring share a bucket.  Inside a bucket codes within ``MAX_BITS`` are
found first, and only vectors with such a neighbour are fetched and reranked by their original
components, in matrix products.  A pair counts in the first table that it shares alone, so the links
of a vector are summed without listing pairs; a bucket leaves as a forest, one edge per member.

Copies are one vector with a count.  Buckets beyond ``TILE`` members are cut into tiles by a hash, and
every two tiles are compared in a task of their own: exact at any size.  Tables that grow with the vectors
are joined by sort and merge, as a broadcast of them would pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanescope.llm import arrays
from lanescope.llm.components import components
from lanescope.llm.shared import written

THRESHOLD = 0.9
BITS, SUBSTRING, DEALS = 64, 16, 8
#: Codes further apart are no candidates; at a cosine of 0.9 some 9 of 64 bits differ, 3 either way.
MAX_BITS = 20
#: Distinct vectors that the rotation is learnt on, at most, and steps of learning.
SAMPLE, STEPS = 20_000, 50
#: Share of made neighbours that the tables have to find, and how many are made.
RECALL, TRIALS = 0.95, 4000
TILE = 4096
#: Pairs of codes compared at a time, about.
PAIRS = 1 << 20
SEED = 20240611

ROWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()),
    T.StructField("unit", T.BinaryType()),
])
BUCKET = ["set", "part", "ta", "tb"]


def _unit(vector: np.ndarray) -> np.ndarray | None:
    """The vector scaled to length one, whatever the size of its components; None for zero."""
    vector = vector + 0.0  # -0.0 is 0.0
    largest = np.abs(vector).max(initial=0.0)
    if not 0 < largest < np.inf:
        return None
    vector = vector / largest
    return vector / np.sqrt((vector * vector).sum())


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with a digest of the vector and the unit vector; both null if it takes no part."""
    for batch in batches:
        lists = batch.column("v")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        keys, units = [], []
        for at, end in zip(np.append(0, ends[:-1]), ends):
            own = values[at:end]
            unit = _unit(own) if np.isfinite(own).all() else None
            keys.append(None if unit is None else hashlib.sha256((own + 0.0).tobytes()).digest())
            units.append(None if unit is None else unit.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            names=ROWS.names,
        )


def _matrix(units: pa.Array) -> np.ndarray:
    """Unit vectors of one length as a matrix."""
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)


def learn(sample: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (components x BITS) of unit vectors, by iterative quantisation.

    Centred at their mean, vectors have balanced codes; but where all lie in a narrow cone, that
    turns small angles into large ones.  So the centre moves from the mean towards zero until the
    tables find RECALL of neighbours made for it, with cosines spread from the threshold to 1.
    """
    for share in (1.0, 0.5, 0.25, 0.0):
        model = _rotated(sample, share * sample.mean(axis=0))
        if share == 0 or _found(model, sample, threshold) >= RECALL:
            return model


def _rotated(sample: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of fewer components than BITS have their code filled up by random projections."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1]
    bits = min(BITS, width)
    centred = sample - centre
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    reduced = centred @ axes
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(STEPS):
        codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ reduced)
        rotation = (left @ right).T
    projection = axes @ rotation
    while projection.shape[1] < BITS:
        more = np.linalg.qr(rng.normal(size=(width, width)))[0]
        projection = np.concatenate([projection, more], axis=1)[:, :BITS]
    return centre, projection


def neighbours(units: np.ndarray, threshold: float, seed: int = SEED) -> np.ndarray:
    """For each unit vector one in a random direction from it, at cosines from the threshold to 1."""
    rng = np.random.default_rng(seed)
    across = rng.normal(size=units.shape)
    across -= (across * units).sum(axis=1)[:, None] * units
    across /= np.maximum(np.linalg.norm(across, axis=1), 1e-12)[:, None]
    cosine = rng.uniform(threshold, 1.0, len(units))[:, None]
    return cosine * units + np.sqrt(1 - cosine**2) * across


def _found(model: tuple[np.ndarray, np.ndarray], sample: np.ndarray, threshold: float) -> float:
    """Share of such neighbours whose codes meet in a table."""
    units = np.resize(sample, (TRIALS, sample.shape[1]))
    apart = _codes(units, model) ^ _codes(neighbours(units, threshold), model)
    shared = np.zeros(len(apart), bool)
    for mask in _masks():
        shared |= (apart & mask) == 0
    return float((shared & (np.bitwise_count(apart) <= MAX_BITS)).mean())


def _codes(units: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None:  # a length that the sample does not hold
        model = learn(np.eye(units.shape[1]))
    mean, projection = model
    signs = ((units - mean) @ projection >= 0).astype(np.uint8)
    return np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]


def _deals() -> np.ndarray:
    """For each table, the bits of the code that it looks at: four disjoint substrings a deal."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([
        rng.permutation(BITS).reshape(BITS // SUBSTRING, SUBSTRING) for _ in range(DEALS)
    ])


def _masks() -> np.ndarray:
    return np.bitwise_or.reduce(np.uint64(1) << _deals().astype(np.uint64), axis=1)


def fit(distinct: DataFrame, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A model for each vector length, from the SAMPLE vectors with the least digests."""
    chosen = _least(distinct.select("key", "unit")).orderBy("key").limit(SAMPLE).toArrow()
    units = chosen.column("unit").combine_chunks()
    sizes = np.array([len(u) // 8 for u in units.to_pylist()], int)
    return {
        int(size): learn(
            _matrix(units.take(pa.array(np.flatnonzero(sizes == size)))), threshold)
        for size in np.unique(sizes)
    }


def _least(rows: DataFrame) -> DataFrame:
    """Rows that hold those with the SAMPLE least digests, about twice as many in all.

    Every task would send SAMPLE rows of its own to the one that merges them.  Digests are spread
    evenly, so that twice the share lacks SAMPLE rows only by a failure of SHA-256.
    """
    n = rows.count()
    if n <= 4 * SAMPLE:
        return rows
    bound = (2 * SAMPLE * (1 << 64) // n).to_bytes(8, "big")
    return rows.where(F.col("key") < F.lit(bytearray(bound)))


def coded(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, width, code) of every distinct vector."""
    models = fit(distinct, threshold)
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit")
            sizes = np.array([len(u) // 8 for u in units.to_pylist()], np.int32)
            codes = np.zeros(len(sizes), np.uint64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                codes[rows] = _codes(_matrix(units.take(pa.array(rows))), shared.value.get(int(size)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sizes), pa.array(codes.view(np.int64))],
                names=["node", "width", "code"],
            )

    return distinct.select("node", "unit").mapInArrow(run, "node long, width int, code long")


def bucketed(codes: DataFrame) -> DataFrame:
    """Every code under each table; tiles (ta, tb) of buckets beyond TILE members, else (0, 0).

    A member of tile x is sent to all pairs of tiles that hold x.
    """
    masks = [int(m) - (1 << 64 if m >> 63 else 0) for m in _masks().tolist()]
    tables = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("set", "mask")
    rows = codes.select("node", "code", "width", tables).select(
        "node", "code", F.col("set").cast("short").alias("set"),
        F.xxhash64(F.col("code").bitwiseAND(F.col("mask")), "width").alias("part"),
    )
    large = rows.groupBy("set", "part").agg(F.count("*").alias("members")).where(
        F.col("members") > TILE
    ).select("set", "part", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node", "code"), F.coalesce("tiles", F.lit(1))).cast("int")
    return (
        rows.join(large, ["set", "part"], "left").withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
        .select("set", "part", F.least("tile", "other").alias("ta"),
                F.greatest("tile", "other").alias("tb"), "tile", "node", "code")
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets of sorted rows, several in a table; the last of a batch waits for the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        fresh = _starts(table)
        held = table.slice(int(fresh[-1]))
        if fresh[-1]:
            yield table.slice(0, int(fresh[-1])).combine_chunks()
    if held is not None and len(held):
        yield held.combine_chunks()


def _starts(table: pa.Table) -> np.ndarray:
    columns = [table.column(c).to_numpy() for c in BUCKET]
    fresh = np.ones(len(table), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _first_shared(
    a: np.ndarray, b: np.ndarray, number: np.ndarray, masks: np.ndarray
) -> np.ndarray:
    """Whether pairs of codes, which share table ``number``, share none before it."""
    apart, first = a ^ b, np.ones(len(a), bool)
    for table, mask in enumerate(masks):
        first &= ((apart & mask) != 0) | (number <= table)
    return first


def _near_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each bucket that have a neighbour by code."""
    masks = _masks()
    for table in _by_bucket(batches):
        begin = _starts(table)
        size = np.diff(np.append(begin, len(table)))
        codes = table.column("code").to_numpy().view(np.uint64)
        sets, tile = table.column("set").to_numpy().astype(np.int64), table.column("tile").to_numpy()
        across = table.column("ta").to_numpy() != table.column("tb").to_numpy()
        near = np.zeros(len(table), bool)
        # Slices of whole buckets with PAIRS pairs at most, or one row of a bucket against all of it.
        rows = np.repeat(size, size)
        cost = np.cumsum(rows)
        at = 0
        while at < len(table):
            to = max(at + 1, int(np.searchsorted(cost, cost[at] - rows[at] + PAIRS, side="right")))
            x = np.repeat(np.arange(at, to), rows[at:to])
            y = arrays.ranges(np.repeat(begin, size)[at:to], rows[at:to])
            close = (np.bitwise_count(codes[x] ^ codes[y]) <= MAX_BITS) & (x != y)
            x, y = x[close], y[close]
            apart = ~across[x] | (tile[x] != tile[y])
            x, y = x[apart], y[apart]
            near[x[_first_shared(codes[x], codes[y], sets[x], masks)]] = True
            at = to
        yield from table.filter(pa.array(near)).combine_chunks().to_batches()


def _rerank(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each member within its bucket, and the root of its tree there."""
        masks = _masks()
        for table in _by_bucket(batches):
            begin = _starts(table)
            size = np.diff(np.append(begin, len(table)))
            node, weight = table.column("node").to_numpy(), table.column("copies").to_numpy()
            codes = table.column("code").to_numpy().view(np.uint64)
            sets, tile = table.column("set").to_numpy(), table.column("tile").to_numpy()
            ta, tb = table.column("ta").to_numpy(), table.column("tb").to_numpy()
            links, root = np.zeros(len(table), np.int64), node.copy()
            for at, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
                own = slice(at, at + n)
                units = _matrix(table.column("unit").slice(at, n).combine_chunks())
                across = ta[at] != tb[at]
                edges = []
                for row in range(0, n, 512):
                    some = slice(row, min(n, row + 512))
                    linked = units[some] @ units.T >= threshold
                    linked[np.arange(some.stop - row), np.arange(row, some.stop)] = False
                    if across:
                        linked &= tile[own][some, None] != tile[own][None, :]
                    x, y = np.nonzero(linked)
                    x += row
                    kept = _first_shared(codes[own][x], codes[own][y], np.full(len(x), sets[at]), masks)
                    x, y = x[kept], y[kept]
                    links[own] += np.bincount(x, weight[own][y], n).astype(np.int64)
                    edges.append(_forest(x, y, n))
                root[own] = node[own][_roots(np.concatenate(edges), n)]
            there = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[there]) for x in (node, links, root)], names=["node", "links", "root"]
            )

    return run


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Edges that connect what (x, y) connect, at most one per member."""
    root = _roots(np.column_stack([x, y]), n)
    moved = np.flatnonzero(root != np.arange(n))
    return np.column_stack([moved, root[moved]])


def _roots(edges: np.ndarray, n: int) -> np.ndarray:
    """The least member reachable from each, by least neighbours and pointer jumping."""
    root = np.arange(n)
    while len(edges):
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        edges, a, b = edges[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _sorted_by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "node")


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, root) per bucket in which a node has links; ``links`` counts copies too."""
    rows = bucketed(written(coded(distinct, threshold)))
    near = _sorted_by_bucket(rows).mapInArrow(
        _near_codes,
        "set short, part long, ta int, tb int, tile int, node long, code long",
    )
    whole = near.join(distinct.select("node", "copies", "unit").hint("merge"), "node")
    return _sorted_by_bucket(whole).mapInArrow(
        _rerank(threshold), "node long, links long, root long"
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, ``n_links``, ``component_id`` and ``kept`` of every row.

    Two vectors are linked if their cosine in doubles is ``threshold`` or more; pairs come from the
    tables, so a few close to the threshold may be missed, and none below it is linked.  Vectors
    that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors
    of different length neither.  Each row is a vector of its own: rows that repeat an id and a
    vector link with each other.  ``component_id`` is the smallest id reachable, the row's own
    included; ids that are null get it too, and are never kept unless nothing else is there to name
    them (then ``component_id`` and ``kept`` are null and false).  Other columns are ignored; no
    rows give none.
    """
    given = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    rows = written(given.mapInArrow(_prepare, ROWS))
    distinct = written(
        rows.where("key IS NOT NULL").groupBy("key")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("unit").alias("unit"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = written(links(distinct, threshold))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = (
        distinct.select("key", "node", "copies", "least")
        .join(sums.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = nodes.join(least.hint("merge"), "component").select(
        "key", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    # Rows without a key would all meet in one task of the join.
    salted = F.coalesce("key", F.unhex(F.lpad(F.hex(F.xxhash64("id")), 16, "0")))
    return (
        rows.select("id", "key", salted.alias("at"))
        .join(classes.withColumnRenamed("key", "at").hint("merge"), "at", "left")
        .select(
            F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )
