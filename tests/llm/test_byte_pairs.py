"""Byte-pair encoding against the tiktoken library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lanescope.llm import arrays, byte_pairs, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_pairs.read_ranks(PATH), special_tokens={},
    )


def test_scan_and_merges_equal_the_library(library):
    rng = random.Random(1)
    signs = [*" \t\n\r'streveldmxLE1.é\u00a0\u3000ñ漢🙂²\u0301_", "'s", "'re", "'ll", "'ve", " '", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n", "'", "'l", "'r", "x'", "a" * 3000, "ab" * 700, " " * 500 + "x", "<|endoftext|>"]
    own = byte_pairs.encoder(PATH)
    body, offsets = arrays.text_bytes(pa.array(texts))
    ids, first = own.encode(body, offsets)
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode_ordinary(text), text
    assert own.decode(ids).tobytes() == body.tobytes()


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SMALL, "documents").collect()}
    rows = queries.op7_byte_pairs(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = np.array(library.encode_ordinary(docs[row.doc_id]), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_lists_offsets_and_decoding(spark):
    texts = [None, "", "Hello wörld's", "x" * 300, "Hello wörld's"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = byte_pairs.encode(docs, PATH, keep=("doc_id", "text"))
    for row in byte_pairs.decode(encoded, PATH).collect():
        text = (texts[row.doc_id] or "").encode()
        assert bytes(row.decoded) == text
        assert row.n_tokens == len(row.ids) == len(row.token_ends)
        assert (row.token_ends or [0])[-1] == len(text)
    assert byte_pairs.encode(docs.limit(0), PATH).collect() == []
    assert "ids" in byte_pairs.encode(docs, PATH).columns


def test_small_steps_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two " * i) for i in range(20)], "doc_id long, text string")
    encoded = byte_pairs.encode(docs, PATH)
    monkeypatch.setattr(byte_pairs, "DECODED_AT_ONCE", 5)
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_pairs.decode(encoded, PATH).collect()} == {
        i: "one two " * i for i in range(20)
    }
