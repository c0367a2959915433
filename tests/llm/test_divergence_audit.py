"""Divergence audit against SQL, plain counting, and its parts against each other."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import compare
from lanescope.llm import divergence_audit as audit, queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, term string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    seen, own, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(audit.TERM, (text or "").translate(LOWER))
        seen[lang or ""].update(set(terms))
        own[lang or "", source or ""].update(terms)
    found = set()
    kept = {lang: [t for t, n in c.items() if n >= 3] for lang, c in seen.items()}
    for lang, source in own:
        whole[lang].update({t: n for t, n in own[lang, source].items()})

    def shares(counts, terms):
        total = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in terms}

    for lang, source in own:
        terms = kept[lang]
        p = shares(own[lang, source], terms)
        pairs = []
        for other in own:
            if other[0] == lang and other[1] != source:
                q = shares(own[other], terms)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other[1].encode()))
        q = shares(whole[lang], terms)
        best = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in terms
                if own[lang, source][t] and p[t] > q[t]]
        for part, rows in (("pair", pairs), ("term", sorted(best)[: audit.TOP])):
            found |= {(lang, source, part, item.decode(), -value, rank)
                      for rank, (value, item) in enumerate(sorted(rows), 1)}
    return found


def collected(frame):
    return {tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()}


def frame_of(spark, docs, parts=3):
    return spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], DOCS).repartition(parts)


def some_docs(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Alpha,", "beta-gamma", "x1y", "über", "(beta)", "delta—eps", "12", "zeta", "A", "rare%d"]
    docs = [(" ".join(w % i if "%" in w else w for w in rng.choice(words, rng.integers(0, 15))),
             str(rng.choice(["en", "de"])), f"s{rng.integers(0, 4)}") for i in range(n)]
    return docs + [(None, "en", "empty"), ("", None, None), ("alone here", "fr", "one"), (None, "xx", "nothing")]


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    ours = queries.op13_divergence_audit(spark, folder).toPandas()
    theirs = compare.duck(folder).execute(queries.OP13_SQL).df()
    assert len(ours) and compare.differences(ours, theirs) is None


@pytest.mark.parametrize("held, united, block, cells", [(10, 5, 7, 16), (10**6, 10**5, 10**6, 1 << 19)])
def test_parts_of_any_size_equal_plain_counting(spark, monkeypatch, held, united, block, cells):
    for name, value in (("HELD", held), ("UNITED", united), ("BLOCK", block), ("CELLS", cells)):
        monkeypatch.setattr(audit, name, value)
    docs = some_docs(1)
    assert collected(audit.audit(frame_of(spark, docs, 4))) == plain(docs)


def test_tiles_of_sources(spark, monkeypatch):
    monkeypatch.setattr(audit, "TILE", 2)
    docs = some_docs(2, 90)
    assert collected(audit.audit(frame_of(spark, docs))) == plain(docs)


def test_repeated_rows_long_texts_and_the_empty_table(spark):
    docs = [("twice", "en", "a")] * 3 + [("once once once", "en", "b"), ("pair", "en", "a"), ("pair,", "en", "b")]
    docs += [("x" * 300_000 + " tail" * 50_000, "en", "c"), ("tail", "en", "a"), ("(tail)", "en", "a")]
    ours = collected(audit.audit(frame_of(spark, docs)))
    assert ours == plain(docs)
    assert {r[3] for r in ours if r[2] == "term"} == {"twice", "tail"}
    assert audit.audit(frame_of(spark, docs).limit(0)).collect() == []


def test_states_count_documents_to_three():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sets = [set(rng.integers(0, 5, rng.integers(1, 4)).tolist()) for _ in range(rng.integers(1, 6))]
        state = {
            "n": np.array([len(s) for s in sets]), "docs": np.array([min(len(s), 3) for s in sets]),
            "first": np.array([min(s) for s in sets]), "last": np.array([max(s) for s in sets]),
        }
        whole = set().union(*sets)
        half = len(sets) // 2
        parts = audit._reduced(state, np.unique([0, half]) if half < len(sets) else np.array([0]))
        for united in (audit._reduced(state, np.array([0])), audit._reduced(parts, np.array([0]))):
            assert united["docs"][0] == min(3, len(whole))
            assert (united["first"][0], united["last"][0]) == (min(whole), max(whole))


def test_the_shuffle_of_chunks_is_used_twice(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    chunks = audit.chunk_counts(docs, "text", "lang", "source")
    joined = chunks.join(audit.tokenized(chunks), "chunk")
    joined.count()
    plan = joined.selectExpr("sum(n * times + docs + first + last)", "max(lang)", "max(source)", "max(term)")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in text


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(2**53, 10**16, 7)], "n long, own_n long, v long")
    got = rows.select(audit._share("n", "own_n").alias("p")).first().p
    assert got == 1 + 10**9 * (2**53 + 1) // (10**16 + 7)
    assert pa.types.is_int64(pa.array([got]).type)
