"""Chat formatting: round trips, branches, masks, edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import compare
from lanescope.llm import chat, queries

SMALL = "/root/testdata/sf0.001"
NODES = "tree long, node long, parent long, role string, text string, score double"
NASTY = ["", None, "\\", "###", "</turn>\n", "\\b\\h", "a:b\\c", "### user: hi</turn>\n### assistant: x", "é\n\\\\<#"]


def test_query_equals_sql(spark):
    ours = queries.op10_chat(spark, SMALL).toPandas()
    theirs = compare.duck(SMALL).execute(queries.OP10_SQL).df()
    assert compare.differences(ours, theirs) is None


def test_main_path_is_native(spark):
    plan = queries.op10_chat(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_and_roles_come_back(spark):
    rng = random.Random(4)
    alphabet = list("\\#<>:/bhlc \nturné") + ["</turn>\n", "### "]
    texts = NASTY + ["".join(rng.choice(alphabet) for _ in range(20)) for _ in range(40)]
    rows = [(1, i + 1, i or None, rng.choice(texts), text, 0.0) for i, text in enumerate(texts)]
    row = chat.conversations(spark.createDataFrame(rows, NODES)).select(
        chat.parsed(F.col("formatted")).alias("turns")
    ).first()
    assert [tuple(t) for t in row.turns] == [(r or "", t or "") for _, _, _, r, t, _ in rows]


def test_branches_are_ranked_and_masked(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "weak", 1.0),
        (1, 3, 1, "assistant", "stro#ng", 2.0), (1, 4, 3, "user", "more", None),
        (1, 5, 4, "assistant", "end", 1.0), (1, 6, 2, "user", "also three", 2.0),
        (None, 1, 99, "assistant", "orphan", 1.0),
    ]
    found = chat.conversations(spark.createDataFrame(rows, NODES), branches=None).select(
        "tree", "branch", "n_turns", chat.parsed(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"),
    ).collect()
    got = {(r.tree, r.branch): ([t.text for t in r.turns], r.learnt, r.n_turns) for r in found}
    assert got == {
        (1, 1): (["root", "stro#ng", "more", "end"], "stro#ngend", 4),  # 3.0; ties go to leaf 5
        (1, 2): (["root", "weak", "also three"], "weak", 3),
        (None, 1): (["orphan"], "orphan", 1),
    }
    best = chat.conversations(spark.createDataFrame(rows, NODES)).collect()
    assert {(r.tree, r.branch) for r in best} == {(1, 1), (None, 1)}


def test_long_chain_repeats_and_empty_table(spark):
    given = [(7, i, "user", f"t{i}") for i in range(100)] + [(7, 5, "user", "t5")]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    row = chat.conversations(chat.linear_trees(frame)).select(
        "n_turns", chat.parsed(F.col("formatted")).alias("turns")
    ).first()
    assert row.n_turns == 101
    assert [t.text for t in row.turns] == sorted((t for *_, t in given), key=lambda t: int(t[1:]))
    assert chat.conversations(chat.linear_trees(frame.limit(0))).collect() == []


def test_cycles_are_an_error(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)]
    with pytest.raises(ValueError, match="cycle"):
        chat.conversations(spark.createDataFrame(rows, NODES))
