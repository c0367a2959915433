"""Exact top-k search by inner product: tiled matrix products, merged as a tree.

Queries are broadcast in blocks of at most ``BLOCK_QUERIES``; more queries take several passes over
the candidates, so what is broadcast is bounded whatever the input.  Within a pass, each task
multiplies a tile of its candidates with a tile of the queries, selects the best k per query and
merges them with the best of its tiles before.  The tasks' lists are then merged in rounds of
``FAN_IN`` lists per query, so no task ever holds more than that many short lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanescope.llm.shared import written

BLOCK_QUERIES = 32_768
#: Bytes of query vectors in one broadcast, at most.
BLOCK_BYTES = 64 << 20
QUERY_TILE, CANDIDATE_TILE = 512, 2048
FAN_IN = 16

FOUND = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("list", T.LongType()),
])


def scaled(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, v): components floor(scale * x) as doubles, of rows whose vectors are whole and finite."""
    x = F.transform(vector, lambda c: F.floor(F.lit(scale).cast("double") * c.cast("double")))
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return (
        vectors.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull() & usable)
        .select(F.col(id_column).cast("long").alias("id"), x.cast("array<double>").alias("v"))
    )


def _matrices(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ids = ids.to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield ids[rows], values[offsets[rows][:, None] + np.arange(length)]


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles while sums stay below 2^53, else in long integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0))
    bound *= queries.shape[1]
    if bound < 2**53:
        return queries @ tile.T
    if bound < 2**63:
        return queries.astype(np.int64) @ tile.astype(np.int64).T
    raise OverflowError("an inner product may exceed a long integer")


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest of each row, the first among equals; scores are spent."""
    k = min(k, scores.shape[1])
    columns, values = np.empty((len(scores), k), np.int64), np.empty((len(scores), k))
    rows = np.arange(len(scores))
    for i in range(k):
        columns[:, i] = scores.argmax(axis=1)
        values[:, i] = scores[rows, columns[:, i]]
        scores[rows, columns[:, i]] = -np.inf
    return columns, values


class Lists:
    """The best k so far of every query of one vector length."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.query_ids, self.matrix, self.k = ids, matrix, k
        self.ids = np.zeros((len(ids), k), np.int64)
        self.scores = np.zeros((len(ids), k), np.int64)
        self.there = np.zeros((len(ids), k), bool)

    def add(self, ids: np.ndarray, tile: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, tile = ids[order], tile[order]
        for at in range(0, len(self.query_ids), QUERY_TILE):
            own = slice(at, at + QUERY_TILE)
            exact = _products(self.matrix[own], tile)
            if exact.dtype == np.int64:
                self._merge_slowly(own, ids, exact)
                continue
            exact[self.query_ids[own, None] == ids[None, :]] = -np.inf
            columns, scores = _select(exact, self.k)
            there = np.isfinite(scores)
            self._merge(own, ids[columns], np.where(there, scores, 0).astype(np.int64), there)

    def _merge_slowly(self, own: slice, ids: np.ndarray, exact: np.ndarray) -> None:
        there = self.query_ids[own, None] != ids[None, :]
        self._merge(own, np.broadcast_to(ids, exact.shape), exact, there)

    def _merge(self, own: slice, ids: np.ndarray, scores: np.ndarray, there: np.ndarray) -> None:
        ids = np.concatenate([self.ids[own], ids], axis=1)
        scores = np.concatenate([self.scores[own], scores], axis=1)
        there = np.concatenate([self.there[own], there], axis=1)
        order = np.lexsort((ids, -scores, ~there), axis=1)[:, : self.k]
        self.ids[own], self.scores[own], self.there[own] = (
            np.take_along_axis(x, order, 1) for x in (ids, scores, there)
        )


def _search(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lists = {m.shape[1]: Lists(ids, m, k) for ids, m in blocks.value}
        for batch in batches:
            for ids, matrix in _matrices(batch.column("id"), batch.column("v")):
                own = lists.get(matrix.shape[1])
                for at in range(0, len(ids) if own else 0, CANDIDATE_TILE):
                    own.add(ids[at : at + CANDIDATE_TILE], matrix[at : at + CANDIDATE_TILE])
        for own in lists.values():
            kept = own.there
            query = np.repeat(own.query_ids, kept.sum(axis=1))
            number = np.full(len(query), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(own.ids[kept]), pa.array(own.scores[kept]),
                 pa.array(number, pa.int64())],
                names=FOUND.names,
            )

    return run


def _merged(found: DataFrame, lists: int, k: int) -> DataFrame:
    """Lists of the tasks merged in a tree, ``FAN_IN`` at a time."""
    while True:
        lists = -(-lists // FAN_IN)
        group = F.floor(F.col("list") / FAN_IN).cast("long")
        ranked = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "vec_id")
        found = (
            found.withColumn("list", group)
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k)
        )
        if lists <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query vector.

    Components count as floor(scale * x).  ``is_query`` is a condition on the id column; candidates
    are all rows with another id; ties go to the smaller id.  Vectors (or ids) that are null, or
    vectors that hold null or a non-finite component, take no part; neither do candidates of another
    length than the query.  Fewer candidates give fewer rows.  Rows that repeat an id count each on
    its own as candidates; a repeated query id is asked once, with the least of its vectors.
    Other columns are ignored.  Sums beyond a long integer are an error.
    """
    spark = vectors.sparkSession
    candidates = scaled(vectors, id_column, vector, scale)
    queries = scaled(vectors.where(is_query), id_column, vector, scale)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    size = queries.agg(
        F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8 + 8).alias("bytes")
    ).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(-(-size.n // BLOCK_QUERIES), -(-size.bytes // BLOCK_BYTES))
    results = []
    for number in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        asked = block.toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        ids, lists = asked.column("id").combine_chunks(), asked.column("v").combine_chunks()
        shared = spark.sparkContext.broadcast(list(_matrices(ids, lists)))
        found = written(candidates.mapInArrow(_search(shared, k), FOUND))
        shared.destroy()
        count = found.agg(F.max("list")).first()[0]
        results.append(_merged(found, (count or 0) + 1, k))
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    return merged
