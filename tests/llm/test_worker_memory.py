"""Python workers of the pipeline give back memory, as they wait for later stages of the same session."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from lanescope.llm import byte_pairs, passages, shared, simhash, toxicity

TEXTS = pa.RecordBatch.from_arrays(
    [pa.array([1, 2, 3]), pa.array(["a b c", None, ""])], names=["doc_id", "text"]
)
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def scored(docs):
    model = toxicity.train(pa.array(["bad", "good"]), toxicity.np.array([1, 0]))
    return toxicity.scored(docs, model, keep=["doc_id"])


@pytest.mark.parametrize("stage", [
    scored,
    lambda docs: simhash.fingerprinted(docs, "text", ["doc_id"]),
    lambda docs: byte_pairs.encode(docs, PATH, keep=("doc_id",)),
], ids=["toxicity", "simhash", "byte_pairs"])
def test_stages_give_back_memory_after_each_batch(spark, monkeypatch, stage):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    tasks, calls = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda frame, task, *_: tasks.append(task) or frame)
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    stage(docs)
    rows = [r for b in tasks[0](iter([TEXTS] * 2)) for r in b.to_pylist()]
    assert len(rows) == 6 and len(calls) == 2


def test_passages_give_back_memory_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([5, 6], pa.int32()), pa.array(["a b", "c"])], names=["__id", "__tie", "text"]
    )
    for task in (passages._make_windows, passages._make_seeds):
        list(task(iter([batch] * 3)))
    assert len(calls) == 6
