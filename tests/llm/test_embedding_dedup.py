"""Quantised near-duplicates against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

import compare
from lanescope.llm import embedding_dedup as dedup, queries

MEDIUM = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, node string, links string"


def brute(rows, threshold=0.9):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
              and any(v) for _, v in rows]
    n = len(rows)
    near = [[] for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and usable[a] and usable[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], float) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].append(b)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    found = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        found.append((own, len(near[i]), least, own is not None and own == least))
    return sorted(found, key=str)


def ours(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, dedup.near_duplicates(frame, **options).collect()), key=str)


def families(seed, families, members, width=64, noise=0.05, apart=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        centre = rng.normal(size=width)
        for _ in range(members):
            rows.append((len(rows) + apart, (centre + noise * rng.normal(size=width)).tolist()))
    return rows


def test_query_equals_sql(spark):
    mine = queries.op11_embedding_dedup(spark, MEDIUM).toPandas()
    theirs = compare.duck(MEDIUM).execute(queries.OP11_SQL).df()
    assert compare.differences(mine, theirs) is None


def test_families_and_edges_equal_brute_force(spark):
    rows = families(1, 12, 6) + families(2, 60, 1, apart=500)
    rows += [(900, rows[0][1]), (901, [3 * x for x in rows[0][1]]), (2, rows[2][1]), (None, rows[7][1]),
             (902, None), (903, []), (904, [0.0] * 64), (905, [float("nan")] * 64), (906, [1.0, None]),
             (907, [float("inf")] * 3), (908, [1.0, 2.0]), (909, [1.0, 2.1]), (910, [1e200, 2e200]),
             (911, [-0.0, 1.0]), (912, [0.0, 1.0]), (913, [1e-300, 1e-300]), (None, None), (None, [5.0] * 7)]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile, pairs", [(8, 50), (50, 1 << 20)])
def test_large_buckets_are_tiled_exactly(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(dedup, "TILE", tile)
    monkeypatch.setattr(dedup, "PAIRS", pairs)
    rows = families(3, 1, 120) + families(4, 3, 20, apart=200)
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("offset", [0.0, 0.5])
def test_recall_down_to_the_threshold(offset):
    """Pairs with cosines spread evenly over 0.9 to 1; in a narrow cone around an axis too."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4000, 64))
    base[:, 0] += offset * 8
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = dedup.neighbours(base, 0.9, seed=6)
    np.testing.assert_array_less(0.9 - 1e-9, (base * near).sum(axis=1))
    model = dedup.learn(base)
    a, b = dedup._codes(base, model), dedup._codes(near, model)
    apart = a ^ b
    shared = np.zeros(len(a), bool)
    for mask in dedup._masks():
        shared |= (apart & mask) == 0
    found = shared & (np.bitwise_count(apart) <= dedup.MAX_BITS)
    assert found.mean() >= 0.93
    if offset:
        return
    # Codes are balanced: every bit is set in about half of the vectors.
    bits = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1)
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.05


def test_tables_and_models():
    masks = dedup._masks()
    assert len(masks) == 32 and all(int(m).bit_count() == 16 for m in masks)
    for deal in masks.reshape(8, 4):
        assert np.bitwise_or.reduce(deal) == np.uint64(2**64 - 1)
    for width in (1, 3, 64, 100):
        mean, projection = dedup.learn(np.random.default_rng(width).normal(size=(50, width)))
        assert mean.shape == (width,) and projection.shape == (width, 64)


def test_no_vectors(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert dedup.near_duplicates(frame).collect() == []
    assert ours(spark, [(1, None), (2, [])]) == [(1, 0, 1, True), (2, 0, 2, True)]
