"""The pipeline stage by stage against plain restatements on a small table."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lanescope.llm import byte_pairs
from lanescope.llm.shared import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with toxic words, copies, a shared passage and benchmark passages."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, item = words(70), words(30)
    docs, kind = [], {}
    for i in range(400):
        text, what = words(rng.randint(60, 150)), "clean"
        if i % 10 == 3:
            text.insert(rng.randrange(len(text)), "zzvile")
            text.insert(rng.randrange(len(text)), "zzrotten")
            what = "toxic"
        elif i % 40 == 5:
            text[20:20], what = passage, "passage"
        elif i % 50 == 7:
            text[10:10], what = item[5:20], "leak"
        docs.append([i, " ".join(text)])
        kind[i] = what
    for i, of in ((400, 0), (401, 0), (402, 1)):
        docs.append([i, docs[of][1]])
        kind[i] = "copy"
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(kind[i] == "toxic")) for i, _ in docs], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder, dict(map(tuple, docs)), kind


def test_each_stage_takes_out_what_is_planted(spark, planted):
    folder, texts, kind = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    without = set(texts)
    for name, gone in zip(names, (["toxic"], ["copy"], [], ["leak"], [])):
        without -= {i for i in texts if kind[i] in gone}
        assert set(kept[name]) == without, name
    first = min(i for i in texts if kind[i] == "passage")
    for i, text in kept[names[2]].items():
        if kind[i] == "passage" and i != first:
            assert len(text.split()) == len(texts[i].split()) - 70
        else:
            assert text == texts[i]
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    for row in docs.collect():
        assert row.ids == library.encode_ordinary(kept[names[3]][row.doc_id])
        assert row.text == kept[names[3]][row.doc_id] and row.n_chars == len(row.text)


def test_nulls_and_empty_tables(spark, planted):
    folder, _, _ = planted
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "a b", "en", "s", 3),
            (3, "a b", "en", "s", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, folder))
        # The empty texts are one group, the repeated rows another.
        assert sorted((r.doc_id for r in docs.collect()), key=str) == ([1, 3] if given else [])


def test_run_equals_the_stages(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
    ours = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert ours == {r.doc_id: r.ids for r in docs.collect()}
