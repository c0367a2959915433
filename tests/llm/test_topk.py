"""Exact top-k against SQL and plain products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from lanescope.llm import queries, topk

MEDIUM = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, score string"


def plain(rows, k, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 5 == 0:
            asked[i] = min(asked.get(i, v), v)
    found = set()
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return found


def collected(frame):
    return {tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect()}


def test_query_equals_sql(spark):
    ours = queries.op6_topk(spark, MEDIUM).toPandas()
    theirs = compare.duck(MEDIUM).execute(queries.OP6_SQL).df()
    assert compare.differences(ours, theirs) is None


def test_ties_nulls_lengths_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf")] + [0.0] * 3),
             (64, []), (65, [1.0, 2.0]), (66, [3.0, 4.0]), (70, [0.5, 0.1]), (None, [1.0] * 4),
             (7, [0.01] * 4), (10, [0.02] * 4), (71, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert collected(topk.top_k(frame, F.col("vec_id") % 5 == 0)) == plain(rows, 5)


@pytest.mark.parametrize("tile, block, fan", [(7, 3, 2), (64, 1000, 16)])
def test_tiles_blocks_and_merging(spark, monkeypatch, tile, block, fan):
    monkeypatch.setattr(topk, "CANDIDATE_TILE", tile)
    monkeypatch.setattr(topk, "QUERY_TILE", tile // 2)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "FAN_IN", fan)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(9)
    assert collected(topk.top_k(frame, F.col("vec_id") % 5 == 0, 3)) == plain(rows, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3**18 + i), 1e6 + i]) for i in range(12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert collected(topk.top_k(frame, F.col("vec_id") % 5 == 0, 5, scale=1)) == plain(rows, 5, 1)


def test_no_vectors_and_no_queries(spark):
    frame = spark.createDataFrame([(1, [1.0], "x"), (2, [1.0], "x")], SCHEMA)
    assert topk.top_k(frame, F.col("vec_id") == 99).collect() == []
    assert topk.top_k(frame.limit(0), F.col("vec_id") == 1).collect() == []
    assert collected(topk.top_k(frame, F.col("vec_id") == 1)) == {(1, 1, 2, 256 * 256)}
