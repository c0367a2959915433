"""Decontamination against a plain search of every window."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from lanescope.llm import decontamination as D

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(WORD, text)


def plain(docs, items, window=10):
    found = []
    for doc, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            span = min(window, len(w))
            for i in range(len(w) - span + 1 if w else 0):
                for at in range(len(own) - span + 1):
                    if own[at : at + span] == w[i : i + span]:
                        hit.update(range(at, at + span))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        found.append((doc, len(own), len(hit), len(ids), digest, bool(hit)))
    return sorted(found, key=str)


def cases():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Über", "x9", "delta", "naïve", "zeta"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([3, 10, 14, 30])))) for i in range(8)]
    items += [(50, items[0][1].upper()), (51, ""), (52, None), (53, "single"), (54, "...")]
    docs = []
    for i in range(40):
        body = make(rng.randint(0, 60))
        if i % 3 == 0:
            own = words(items[rng.randrange(8)][1])
            at = rng.randint(0, len(body))
            body[at:at] = own[: rng.randint(1, len(own))]
        docs.append((i, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, "single"), (104, items[3][1] + " " + items[3][1])]
    return docs, items


def digest(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                   for r in D.contamination(found).collect()), key=str)


def test_equals_plain_search(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, "m", 1) for d in docs], "doc_id long, text string, matches string, n_words int")
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    assert digest(D.matches(frame, benchmark)) == plain(docs, items)
    kept = D.clean(frame, benchmark)
    assert kept.columns == frame.columns
    clean = {r[0] for r in plain(docs, items) if not r[5]}
    assert {r.doc_id for r in kept.collect()} == clean


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    monkeypatch.setattr(D, "PART_WORDS", 12)
    monkeypatch.setattr(D, "SHARD_WORDS", 90)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in D._blocks(benchmark)) > 1
    assert digest(D.matches(frame, benchmark)) == plain(docs, items)


def test_a_pass_is_written_before_the_next_block_is_read(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    steps, blocks, write = [], D._blocks, D.written

    def seen_blocks(table):
        for block, last in blocks(table):
            steps.append("block")
            yield block, last

    def seen_write(table):
        steps.append("written")
        return write(table)

    monkeypatch.setattr(D, "_blocks", seen_blocks)
    monkeypatch.setattr(D, "written", seen_write)
    assert digest(D.matches(frame, benchmark)) == plain(docs, items)
    n = sum(1 for _ in blocks(benchmark))
    assert n > 1 and steps == ["block", "written"] * (n - 1) + ["block"]


def test_longest_matches_and_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    match, = D.matches(frame, benchmark).first().matches
    assert tuple(match) == (9, 5, 2, 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.clean(none, items).collect() == []
    assert D.clean(some, items.limit(0)).count() == 1
    row = D.contamination(D.matches(some, items.limit(0))).first()
    assert (row.n_hit, row.items_sha256) == (0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("slow", [False, True])
def test_suffixes_are_sorted(slow):
    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 4, 400).astype(np.uint64)
    array = D.SuffixArray(hashes, np.array([0, 150, 150, 400]), 64)
    order = array._sorted_slowly(64) if slow else array.order
    suffixes = [array.words[i : i + 64].tolist() for i in order]
    assert suffixes == sorted(suffixes)
