import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lociforge.llm import packing, wordcache
from lociforge.llm.packing import assigned, packed, sequences

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer(tokenizers_dir):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers_dir.path(FILE))


def _held(pieces, lengths, size):
    """Every token once, sequences without gaps and of whole length or a power of two."""
    ranges, places = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert n > 0
        ranges[d].append((start, n))
        places[s].append((offset, n))
    for got, wanted in ((ranges, dict(enumerate(lengths))), (places, None)):
        for k, own in got.items():
            end = 0
            for start, n in sorted(own):
                assert start == end
                end += n
            assert end == wanted[k] if wanted else end == size or end & (end - 1) == 0
    assert {d for d, n in enumerate(lengths) if n} == set(ranges)
    assert set(places) == set(range(len(places)))


@pytest.mark.parametrize("size", [1, 7, 64, 2048])
def test_all_tokens_are_placed(size):
    rng = random.Random(size)
    for lengths in ([], [0, 0], [1], [size], [size - 1] * 9, [3 * size + 1, 1], [rng.randint(0, 3 * size) for _ in range(300)], [1] * 500):
        _held(assigned(lengths, size), lengths, size)


def test_costs_are_even():
    rng = random.Random(2)
    lengths = [rng.randint(20, 900) for _ in range(4000)]

    def spread(pieces):
        cost, used = Counter(), Counter()
        for _, _, n, s, _ in pieces:
            cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
            used[s] += n
        full = np.array([c for s, c in cost.items() if used[s] == packing.LENGTH])
        return full.std() / full.mean()

    in_order, at = [], 0
    for d, n in enumerate(lengths):  # documents one after another, cut where a sequence ends
        start = 0
        while start < n:
            take = min(n - start, packing.LENGTH - at % packing.LENGTH)
            in_order.append((d, start, take, at // packing.LENGTH, at % packing.LENGTH))
            start, at = start + take, at + take
    own = assigned(lengths)
    assert spread(own) < 0.5 * spread(in_order)
    assert len(own) < len(in_order)  # and fewer cuts


def test_ids_of_pieces_are_the_texts(tokenizer, tokenizers_dir, monkeypatch):
    rng = random.Random(3)
    alphabet = [" "] * 8 + list("ab'1.s\n\t  \u0085\x0b\x1c\x01\x02é<|") + ["<|endoftext|>", "'s", "don't", "   ", "　"]
    monkeypatch.setattr(wordcache, "RUN", 10)
    encoder = wordcache.byte_encoder(tokenizers_dir.path(FILE))
    for _ in range(60):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(50)]
        ids, n = encoder(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("block", [1, 700, packing.BLOCK_TOKENS])
def test_documents(spark, docs, texts, tokenizer, tokenizers_dir, block):
    want = [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    rows = packed(docs, tokenizers_dir.path(FILE), block_tokens=block, with_ids=True).collect()
    _held([(r.doc_id, r.start, r.length, *p) for r, p in zip(rows, _dense(rows), strict=True)], [len(x) for x in want], packing.LENGTH)
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert (r.ids, r.doc_tokens) == (own, len(want[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    joined = sequences(packed(docs, tokenizers_dir.path(FILE), block_tokens=block, with_ids=True), pad_id=9).collect()
    assert sum(len(r.ids) for r in joined) == sum(map(len, want))  # no padding
    assert sorted(i for r in joined for i in r.ids) == sorted(i for x in want for i in x)


def _dense(rows):
    number = {s: k for k, s in enumerate(sorted({r.sequence_id for r in rows}))}
    return [(number[r.sequence_id], r.offset) for r in rows]


def test_edges(spark, awkward, empty, tokenizers_dir):
    path = tokenizers_dir.path(FILE)
    assert packed(empty, path).collect() == []
    rows = packed(awkward, path).collect()
    assert sum(r.start == 0 for r in rows) == awkward.count()
    assert sum(r.length for r in rows if r.doc_id is None) > 1
    bare = spark.createDataFrame([(1, None), (2, "")], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert [(r.doc_id, r.length) for r in packed(bare, path).sort("doc_id").collect()] == [(1, 1), (2, 1)]
    assert packed(bare, path, end_id=None).collect() == []
