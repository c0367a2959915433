"""Token files: ids of the library, order, encodings, selective reads."""

from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lanescope.llm import arrays, queries, token_files
from lanescope.llm.shared import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, docs):
    start, rows = 0, []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        rows.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_more_ranges_give_the_same(spark, library, monkeypatch):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect())
    given = queries.table(spark, SMALL, "documents")
    monkeypatch.setattr(token_files, "RANGE_BYTES", 20_000)
    ranges = token_files._ranges(given.select("text"))
    assert ranges > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sorted(map(tuple, queries.op8_token_files(spark, SMALL).collect()))
    assert found == expected(library, docs)
    assert token_files._ranges(given.select("text").limit(0)) is None


def test_query_equals_the_library(spark, library):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect())
    found = sorted(map(tuple, queries.op8_token_files(spark, SMALL).collect()))
    assert found == expected(library, docs)


def test_odd_texts_and_order(spark, library, monkeypatch):
    docs = [(5, None), (3, ""), (9, "É́tude don't stop　'll 12ab"), (1, "x" * 2000),
            (7, "<|endoftext|> a<|startoftext|>b"), (8, "Σας ΟΔΟΣ İ ﬁ é ️"), (2, " \t\n"), (4, "same same SAME " * 300)]
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 3)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, file string").repartition(4)
    path = shared_folder(spark)
    token_files.write(frame, PATH, path)
    found = sorted(map(tuple, token_files.digests(token_files.read(spark, path)).collect()))
    assert found == expected(library, sorted(docs))


def test_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "d"), (1, "d"), (0, "e")], "doc_id long, text string")
    path = shared_folder(spark)
    token_files.write(frame, PATH, path)
    rows = sorted(token_files.read(spark, path, ("doc_id", "start", "n_tokens")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    path = shared_folder(spark)
    token_files.write(frame, PATH, path)
    assert token_files.digests(token_files.read(spark, path)).collect() == []


def test_encodings_page_index_and_selective_reads(spark):
    path = shared_folder(spark)
    token_files.write(queries.table(spark, SMALL, "documents"), PATH, path)
    files = [f for f in glob.glob(path.removeprefix("file://") + "/*.parquet") if pq.ParquetFile(f).metadata.num_row_groups]
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    metadata = token_files.read(spark, path, ("doc_id", "start", "n_tokens"))
    assert "ids" not in metadata._jdf.queryExecution().executedPlan().toString()
    few = token_files.read(spark, path).where("doc_id between 10 and 12")
    assert "GreaterThanOrEqual(doc_id,10)" in few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 3


def test_reading_back_moves_no_tokens(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    path = shared_folder(spark)
    token_files.write(docs, PATH, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large files
    try:
        frame = token_files.read(spark, path)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        rows = frame.orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


def test_workers_give_back_memory_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(token_files, "release", lambda: calls.append(1))
    ids = pa.array([[1, 2], [3], [-1]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([0, 2, 3]), ids], names=["doc_id", "start", "ids"]
    )
    rows = [r for b in token_files._crc(iter([batch, batch])) for r in b.to_pylist()]
    assert len(calls) == 2
    assert [r["ids_crc32"] for r in rows[:3]] == [
        zlib.crc32(np.array(x, "<u4").tobytes()) for x in ([1, 2], [3], [0xFFFFFFFF])
    ]
    slices = list(arrays.pieces(token_files._released(iter([
        pa.RecordBatch.from_arrays([pa.array(["a b", None, ""])], names=["text"])] * 3)), "text"))
    assert len(slices) == 3 and len(calls) == 5
