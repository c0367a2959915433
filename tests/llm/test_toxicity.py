"""Toxicity classifier: held-out accuracy, the rule of learnable rows, edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lanescope.llm import arrays, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def made():
    """Invented texts of two languages; the bad words of one share only what they begin with."""
    rng = random.Random(1)
    good = [f"{a}{b}" for a in "bdfgklm" for b in ("ar", "eno", "ilu", "oto", "usk")]
    docs, labels = [], []
    for i in range(1200):
        lang, toxic = ("xx", "yy")[i % 2], i % 5 == 0
        text = [rng.choice(good) + rng.choice(["", "s", "n"]) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 3) if toxic else 0):
            bad = rng.choice(["vile", "Rotten"]) if lang == "xx" else "grobö" + rng.choice(good)
            text.insert(rng.randrange(len(text) + 1), bad)
        docs.append((i, " ".join(text), lang, f"src{i}"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_thresholds(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame(made[1], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    truth = {i: toxic for i, _, toxic in made[1]}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [(r.score >= 0.7) == bool(truth[r.doc_id]) for r in held]
    assert np.mean(right) > 0.97
    assert set(model.thresholds) == {"xx", "yy"}
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    wrong = {r.doc_id for r in kept.collect()} ^ {i for i, t in truth.items() if not t}
    assert len(wrong) < 0.03 * len(truth)


def test_only_learnable_rows_are_learnt(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string, lang string, s string")
    labels = spark.createDataFrame(made[1] + made[1][:5] + [(9999, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels)
    ids = rows.column("doc_id").to_pylist()
    assert len(ids) == len(set(ids))
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert set(ids) == {i for i, *_ in made[1] if zlib.crc32(str(i).encode()) % 3 != 1}


def test_query_columns(spark):
    frame = queries.op1_toxicity(spark, MEDIUM)
    rows = frame.collect()
    assert len(rows) == queries.table(spark, MEDIUM, "documents").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_nulls_empty_and_long_texts(spark, made):
    labels = spark.createDataFrame(made[1], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(
        [*made[0][:400], (5001, None, None, None), (5002, "", "zz", ""), (5003, "... !!", "xx", ""),
         (None, "vile", "xx", ""), (5004, "bar " * 50_000 + "vile", "xx", ""), (5004, "bar", None, "")],
        "doc_id long, text string, lang string, s string",
    )
    model = toxicity.fit(docs, labels)
    scores = {(r.doc_id, r.text): r.score for r in toxicity.scored(docs, model).collect()}
    assert len({scores[5001, None], scores[5002, ""], scores[5003, "... !!"]}) == 1
    assert min(scores[None, "vile"], scores[5004, "bar " * 50_000 + "vile"]) > 0.7
    assert scores[5004, "bar"] < 0.5
    assert toxicity.reject(docs.limit(0), labels).collect() == []
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, unlabelled).collect()} == {0.5}


def test_a_text_is_scored_alike_alone_and_among_others(made):
    texts = [t for _, t, *_ in made[0][:300]]
    model = toxicity.train(pa.array(texts), np.array([t for *_, t in made[1][:300]]))
    together = model.scores(*arrays.text_bytes(pa.array(texts)))
    alone = [model.scores(*arrays.text_bytes(pa.array([t])))[0] for t in texts[:40]]
    assert np.allclose(together[:40], alone, atol=1e-6)


def test_a_repeated_id_gives_one_row_to_the_sample(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(50).where(toxicity.learnable(F.col("id"))).collect()][:2]
    docs = spark.createDataFrame([(ids[0], f"text {i}") for i in range(50)] + [(ids[1], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels)
    assert sorted(zip(rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist())) == sorted([(ids[0], 1), (ids[1], 0)])


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """Words that stand only in texts beyond any sample count, and so do the thresholds' texts."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MAX_OTHER", 5)
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 100)
    rng = random.Random(3)
    good = [f"{a}{b}" for a in "bdfgklm" for b in ("ar", "eno", "ilu", "oto", "usk")]
    rows = []
    for i in range(1500):
        text = rng.choices(good, k=20)
        if i % 3 == 0:
            text[rng.randrange(20)] = f"{'xzqw'[i // 3 % 4]}vile"
        rows.append((i, " ".join(text), "xx", int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = frame.drop("toxic"), frame.select("doc_id", "toxic")
    assert toxicity._shards(docs, labels) > 5
    model = toxicity.fit(docs, labels)
    right = [(r.score >= 0.7) == (r.doc_id % 3 == 0) for r in toxicity.scored(docs, model).collect()]
    assert np.mean(right) > 0.97 and set(model.thresholds) == {"xx"}
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.table, model.table) and again.thresholds == model.thresholds
