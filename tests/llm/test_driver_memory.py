"""Operator 11 sends nothing that grows with the vectors through the driver."""

from __future__ import annotations

import hashlib

import numpy as np

from lanescope.llm import components, embedding_dedup as dedup


def plans_of(monkeypatch, module) -> list[str]:
    seen, written = [], module.written

    def noted(frame, **options):
        seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, **options)

    monkeypatch.setattr(module, "written", noted)
    return seen


def test_no_round_of_components_is_broadcast(spark, monkeypatch):
    seen = plans_of(monkeypatch, components)
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {k: k // 10 * 10 for k in range(40) if k % 10}
    assert len(seen) > 1 and not any("BroadcastExchange" in plan for plan in seen)
    assert any("SortMergeJoin" in plan for plan in seen)


def test_no_table_of_vectors_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(100 + k, v) for k, v in rows[:20]]
    result = dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert "BroadcastExchange" not in result._jdf.queryExecution().executedPlan().toString()
    assert {r.vec_id: r.component_id for r in result.collect()}[105] == 5


def test_tasks_send_a_share_of_the_vectors_and_the_sample_stays(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SAMPLE", 50)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(2000)]
    rows = spark.createDataFrame([(bytearray(k), bytearray(8)) for k in keys], "key binary, unit binary")
    kept = sorted(bytes(r.key) for r in dedup._least(rows).collect())
    assert len(kept) < 200 and kept[:50] == sorted(keys)[:50]
    few = rows.limit(150)
    assert dedup._least(few).count() == 150
