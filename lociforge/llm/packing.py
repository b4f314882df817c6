"""Packing of documents into sequences of equal length and near-equal attention cost.

A piece of n tokens costs ``linear`` * n + ``quadratic`` * n * n: the share of the layers that
grows with the tokens, and attention within the piece. Each task packs its own documents, in
blocks of a few million tokens: runs of a whole sequence are sequences of their own, and the
rests of the documents go, longest first, to the cheapest sequence that has room. A rest that
fits nowhere is cut to fill the sequence with most room. The room of a block is just that of
its tokens: whole sequences, and for what is left sequences at powers of two, which need no
padding. So no row is shuffled, and a lost task is packed again in the same way.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.wordcache import byte_encoder, plain, slices

LENGTH = 2048
#: Cost of a token and of a pair of tokens: attention over n tokens equals the other layers' work at n = 6 * 1024.
LINEAR, QUADRATIC = 6 * 1024, 1
#: Tokens of a block, which a task holds at once; a longer document is a block.
BLOCK_TOKENS = 4 << 20
#: Bytes of text that are cut into words at once.
SLICE = 8 << 20
#: Numbers of sequences that a task may use.
TASK_SEQUENCES = 1 << 40

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("cost", T.LongType()),
])


def rooms(tokens: int, length: int) -> list[int]:
    """Lengths of sequences for so many tokens: whole ones, then powers of two, the greatest first."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assigned(lengths: list[int], length: int = LENGTH, linear: int = LINEAR, quadratic: int = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths.

    Every token is in one piece, every sequence is full, and sequences are numbered from 0.
    """
    pieces, rests, n = [], [], 0
    for d, size in enumerate(lengths):
        whole = size // length
        pieces += [(d, k * length, length, n + k, 0) for k in range(whole)]
        n += whole
        if size % length:
            rests.append((-(size % length), d, whole * length))
    heapq.heapify(rests)
    room = rooms(-sum(r[0] for r in rests), length)
    used = [0] * len(room)
    cheapest = [(0, s) for s in range(len(room))]  # sequences that may have room for the rest at hand
    parked: list[tuple[int, int, int]] = []  # those that have not, most room first
    while rests:
        size, d, start = heapq.heappop(rests)
        size = -size
        while parked and -parked[0][0] >= size:
            _, cost, s = heapq.heappop(parked)
            heapq.heappush(cheapest, (cost, s))
        while cheapest:
            cost, s = heapq.heappop(cheapest)
            if room[s] >= size:
                break
            heapq.heappush(parked, (-room[s], cost, s))
        else:
            _, cost, s = heapq.heappop(parked)
            heapq.heappush(rests, (room[s] - size, d, start + room[s]))
            size = room[s]
        pieces.append((d, start, size, n + s, used[s]))
        used[s] += size
        room[s] -= size
        if room[s]:
            heapq.heappush(cheapest, (cost + linear * size + quadratic * size * size, s))
    return pieces


def packed(
    docs: DataFrame, tokenizer: str, end_id: int | None = 1, length: int = LENGTH, linear: int = LINEAR, quadratic: int = QUADRATIC,
    block_tokens: int = BLOCK_TOKENS, text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    start counts the ids of the document before the piece, offset those of the sequence; cost is
    the piece's. with_ids adds the ids themselves. Null and empty texts have the end id alone
    (without one they have no piece); null and repeated doc_ids are documents like any other, told
    apart by their sequences; other columns are left out; an empty table gives an empty result.
    sequence_id is unique, not dense: a task's sequences follow each other.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = byte_encoder(tokenizer), TaskContext.get().partitionId() * TASK_SEQUENCES
        ids, names, counts, held = [], [], [], 0

        def block():
            nonlocal first
            n = np.concatenate(counts)
            at, found = np.concatenate([[0], np.cumsum(n)]), assigned(n.tolist(), length, linear, quadratic)
            data = np.concatenate(ids).astype("<u4")
            d, start, size, seq, offset = np.array(found, np.int64).reshape(-1, 5).T
            begin = at[d] + start
            raw = memoryview(data).cast("B") if len(data) else memoryview(b"")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
            cols = [[names[k] for k in d.tolist()], start, size, crc, n[d], first + seq, offset, linear * size + quadratic * size * size]
            cols = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                cols.append(pa.array([data[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)], pa.list_(pa.int64())))
            first += int(seq.max()) + 1 if len(seq) else 0
            return pa.RecordBatch.from_arrays(cols, schema.names)

        for batch in batches:
            for part in slices(batch, text, SLICE):
                own, n = encoder(plain(part[text]))
                if end_id is not None:
                    own = np.insert(own, np.cumsum(n), end_id)
                    n = n + 1
                ids.append(own)
                counts.append(n)
                names += part["doc_id"].to_pylist()
                held += len(own)
                if held >= block_tokens:
                    yield block()
                    ids, names, counts, held = [], [], [], 0
        if names:
            yield block()

    schema = T.StructType([*PIECE, T.StructField("ids", T.ArrayType(T.LongType()))]) if with_ids else PIECE
    return docs.select("doc_id", text).mapInArrow(pack, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths, cost) of pieces with ids: ids in place, lengths of the pieces in order, for masks.

    Ids are padded to length unless they are a power of two of them.
    """
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.sum("cost").alias("cost"))
    ids = F.flatten("p.ids")
    n = F.size("ids")
    padded = F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - n)))
    return rows.select("sequence_id", ids.alias("ids"), F.col("p.length").alias("lengths"), "cost").withColumn("ids", padded)
