import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociforge.llm.planes import TRAILER, Segment, pack, read_documents, segments, write_planes
from lociforge.llm.shared import new_folder
from lociforge.llm.tokencount import document_counts, token_counts, with_streams
from lociforge.llm.wordcache import plain, word_encoder

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="session")
def tokenizer(tokenizers_dir):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers_dir.path(NAME))


@pytest.mark.parametrize("special", [True, False])
def test_pieces_give_the_ids_of_whole_texts(tokenizer, tokenizers_dir, texts, special):
    odd = ["It's 3.5%, isn't!", "A.b(C) d.é e!!f", "x<|endoftext|>y <|ENDOFTEXT|>", "é. É ̈a", "word.'s \"q\".-", "  ", "a\x0bb\x85c　d", "'S'S 'LL!"]
    own = [t or "" for t in texts] + odd
    tokenizer.encode_special_tokens = not special
    try:
        expected = [x.ids for x in tokenizer.encode_batch(own, add_special_tokens=False)]
    finally:
        tokenizer.encode_special_tokens = False
    for batch in (own, own[:3], odd):
        ids, n = word_encoder(tokenizers_dir.path(NAME), special)(plain(pa.array(batch, pa.string())))
        upto = np.concatenate([[0], np.cumsum(n)])
        got = {t: ids[a:b].tolist() for t, a, b in zip(batch, upto, upto[1:])}
        assert got == {t: expected[own.index(t)] for t in batch}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=20), max_size=8), st.integers(1, 9))
def test_segments_come_back(rows, chunk):
    ids = np.array([i for r in rows for i in r], np.uint32)
    names = [None if k == 1 else -k for k in range(len(rows))]
    data = pack(ids, names, np.array([len(r) for r in rows]), chunk)
    (back,) = segments(data + TRAILER)
    assert back.ids().tolist() == ids.tolist()
    assert back.docs()[0] == names and back.docs()[1].tolist() == [len(r) for r in rows]
    for k in range(0, len(ids), chunk):
        assert Segment(memoryview(data), 0).read_chunk(k // chunk).tolist() == ids[k : k + chunk].tolist()


def test_a_cut_segment_is_refused():
    data = pack(np.arange(5, dtype=np.uint32), [1], np.array([5]))
    with pytest.raises(ValueError):
        list(segments(data + TRAILER[:2]))


def test_files_hold_all_ids_in_order(spark, docs, texts, tokenizer, tokenizers_dir):
    path = new_folder(spark, "planes")
    write_planes(docs.repartition(3), path, tokenizers_dir.path(NAME), 1, chunk=64, segment_ids=500, file_segments=2)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(spark, path).collect()}
    start, expected = 0, {}
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == expected


def test_files_of_awkward_and_no_documents(spark, awkward, empty, tokenizers_dir):
    path = new_folder(spark, "planes")
    write_planes(awkward, path, tokenizers_dir.path(NAME), 1)
    rows = read_documents(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == [None, None, 3, 5, 5, 9, 9]
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    path = new_folder(spark, "planes")
    write_planes(empty, path, tokenizers_dir.path(NAME), 1)
    assert read_documents(spark, path).count() == 0


def _streams(spark, streams):
    rows = [(k, f"f{i}", bytearray(np.array(ids, "<u2").tobytes())) for k, files in streams.items() for i, ids in enumerate(files)]
    return spark.createDataFrame(rows, "stream long, path string, content binary")


def test_counts_across_blocks_and_files(spark):
    rng = np.random.default_rng(3)
    streams = {1: [rng.integers(0, 4, 50), rng.integers(0, 4, 33)], 2: [[0, 0, 5]], 3: [[7, 8], [9], [0, 1]], 4: [[1, 2, 3]]}
    got = token_counts(_streams(spark, streams), 0, block=4).orderBy("stream", "ordinal").collect()
    expected = []
    for k, files in streams.items():
        ids, at, n = [int(i) for f in files for i in f], 0, 0
        while at < len(ids):
            end = ids.index(0, at) if 0 in ids[at:] else len(ids)
            expected.append((k, n, at, end - at, end < len(ids)))
            at, n = end + 1, n + 1
    assert [tuple(r) for r in got] == expected


def test_written_streams_are_counted(spark, docs, texts, empty, tokenizer, tokenizers_dir):
    rows = docs.withColumn("stream", F.col("doc_id") % 2).withColumn("place", -F.col("doc_id")).repartition(2, "stream")
    own = document_counts(rows, new_folder(spark, "stream"), tokenizers_dir.path(NAME), 49_407)
    assert {r["doc_id"]: r["n_tokens"] for r in own.collect()} == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    none = empty.withColumn("stream", F.lit(1).cast("long")).withColumn("place", F.lit(1).cast("long"))
    assert document_counts(none, new_folder(spark, "stream"), tokenizers_dir.path(NAME), 49_407).count() == 0


def test_counts_do_not_depend_on_how_the_input_is_split(spark, texts, tokenizer, tokenizers_dir, tmp_path):
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": "x"}).to_parquet(tmp_path / "documents.parquet", row_group_size=3)
    docs = with_streams(spark.read.parquet(str(tmp_path / "documents.parquet")))
    expected = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    try:
        for before, after in ((1, 9), (9, 1), (5, 8)):
            for key, value in conf.items():
                spark.conf.set(key, value)
            spark.conf.set("spark.sql.files.minPartitionNum", str(before))
            own = document_counts(docs.select("*"), new_folder(spark, "stream"), tokenizers_dir.path(NAME), 49_407)
            spark.conf.set("spark.sql.files.minPartitionNum", str(after))
            assert {r["doc_id"]: r["n_tokens"] for r in own.collect()} == expected
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_counts_of_awkward_documents_and_clashing_names(spark, tokenizer, tokenizers_dir, tmp_path):
    texts = [None, "", "a b", "a b", "word " * 30_000]
    pd.DataFrame({"doc_id": pd.array([None, 2, 3, 3, 4], "Int64"), "text": texts, "stream": 1, "place": 2, "file_key": 3, "n_tokens": 4, "start": 5}).to_parquet(tmp_path / "documents.parquet")
    docs = with_streams(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = document_counts(docs, new_folder(spark, "stream"), tokenizers_dir.path(NAME), 49_407).collect()
    expected = [(d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in zip([None, 2, 3, 3, 4], texts)]
    assert sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in got)) == sorted((d or 0, n) for d, n in expected)


def test_other_tokenizers_are_refused(tokenizers_dir):
    with pytest.raises(ValueError):
        word_encoder(tokenizers_dir.path("byte_bpe_50k.json"))


def test_numbers_in_folder_names_and_long_documents(spark, docs, texts, tokenizer, tokenizers_dir, tmp_path, monkeypatch):
    """The number of a file is in its own name; a segment of many bytes counts as several; files of two runs are refused."""
    from lociforge.llm import planes

    path, want = tokenizers_dir.path("word_bpe_49k.json"), {}
    for k, x in enumerate(texts):
        want[k] = len(tokenizer.encode(x or "", add_special_tokens=False).ids) + 1
    monkeypatch.setattr(planes, "UNIT", 2000)
    folder = f"file://{tmp_path}/part-7/part-00009-c1/planes"
    write_planes(docs, folder, path, end_id=1, segment_ids=500, file_segments=3)
    rows = {r["doc_id"]: r for r in read_documents(spark, folder).collect()}
    assert {k: r["n_tokens"] for k, r in rows.items()} == want
    assert [rows[k]["start"] for k in sorted(rows)] == np.cumsum([0, *[want[k] for k in sorted(rows)]]).tolist()[:-1]
    sizes = [f.stat().st_size for f in (tmp_path / "part-7/part-00009-c1/planes").glob("part-*")]
    assert sizes.count(12) >= 3  # files of empty segments alone, after a long one
    first = sorted((tmp_path / "part-7/part-00009-c1/planes").glob("part-*"))[0]
    (first.parent / first.name.replace("part-", "part-", 1).replace(first.name[11:19], "ffffffff")).write_bytes(first.read_bytes())
    with pytest.raises(ValueError, match="several runs"):
        read_documents(spark, folder)
