"""Weak labels: accuracies recovered from votes, quality against labels, edge cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lanescope.llm import arrays, queries
from lanescope.llm import weak_labels as W

MEDIUM = "/root/testdata/sf0.01"


def test_accuracies_and_labels_are_recovered():
    rng = np.random.default_rng(1)
    n, m = 40_000, len(W.LABELLERS)
    good = rng.random(n) < 0.85
    caught = np.linspace(0.4, 0.9, m)
    bad_vote = np.where(good[:, None], rng.random((n, m)) < 0.01, rng.random((n, m)) < caught)
    given = np.where(rng.random((n, m)) < 0.1, W.ABSTAIN, np.where(bad_vote, W.BAD, W.GOOD))
    numbers = given @ 3 ** np.arange(m - 1, -1, -1)
    patterns, counts = np.unique(numbers, return_counts=True)
    model = W.LabelModel.fitted(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.01
    share = model.chance[0, :, W.BAD] / (model.chance[0, :, W.BAD] + model.chance[0, :, W.GOOD])
    assert np.abs(share - caught).max() < 0.03
    assert ((model.posterior(numbers) >= 0.5) == good).mean() > 0.99
    accuracies = list(model.accuracies().values())
    assert accuracies == sorted(accuracies)


def test_query_agrees_with_the_labels(spark):
    truth = {r.doc_id: r.quality for r in queries.table(spark, MEDIUM, "labels").collect()}
    rows = queries.op9_weak_labels(spark, MEDIUM).collect()
    assert len(rows) == queries.table(spark, MEDIUM, "documents").count()
    judged = [(truth[r.doc_id], r.predicted) for r in rows if truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert all(len(r.votes) == len(W.LABELLERS) and 0 <= r.posterior <= 1 for r in rows)


def test_nulls_empty_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "A good sentence is here. And one more follows it."),
            (None, "A good sentence is here. And one more follows it."), (6, "bad " * 20_000), (6, "bad " * 20_000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    rows = W.classified(frame).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.score, r.posterior, tuple(r.votes)))
    assert by[1] == by[2] and by[1][0][0] == by[3][0][0] == 0.0
    assert by[5] == by[None] and by[6][0] == by[6][1]
    assert W.classified(frame.limit(0)).collect() == []


def test_votes_do_not_depend_on_neighbours():
    texts = ["The cat sat. It was warm.", "", "GO!! NOW!! GO!!", "a a a a a a a a", "x | y | z | w", None, "ok&&& so%%% no***"]
    whole = W.Words.of(*arrays.text_bytes(pa.array(texts)))
    alone = [W.votes(W.Words.of(*arrays.text_bytes(pa.array([t], pa.string()))))[0] for t in texts]
    assert W.votes(whole).tolist() == alone
    named = dict(zip((f.__name__ for f in W.LABELLERS), W.digits(W.votes(whole)).T))
    assert named["capitals"][2] == W.BAD and named["repeats"][3] == W.BAD
    assert named["wordless"][4] == W.BAD and named["signs"][6] == W.BAD


def test_a_repeated_id_gives_one_row_to_the_sample(spark):
    from lanescope.llm import weak_labels

    rows = [(1, f"text {i}") for i in range(50)] + [(2, None), (3, "other")]
    rows = weak_labels.sample(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    assert rows.column("__id").to_pylist() == [1, 2, 3]
