"""Sampled positions that two sequences sharing a window always share.

Of each run of ``window - gram + 1`` grams of a sequence the last one with the least hash is
an anchor. Every window of ``window`` symbols holds such a run, and the choice depends on
the window alone: where two sequences share a window, they share an anchor in it, at the
same place. So a window can only be shared if a gram at an anchor in it is.

Anchors whose gram only one document has are dropped here, in two steps that keep hot grams
small: a task settles what its own documents share and ships one row for each gram, and only
these meet by gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociforge.llm.shared import staged

_BASE = 0x9E3779B97F4A7C15
#: Symbols of a task's documents that are held before they are combined and shipped.
HELD = 8 << 20
#: Symbols of documents whose anchors are looked for in one go.
TOGETHER = 1 << 18


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xFF51AFD7ED558CCD)


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n symbols from each place on, by doubling."""
    h, size, out, done = symbols.astype(np.uint64) + np.uint64(1), 1, None, 0
    if len(h) < n:
        return h[:0]
    while True:
        if n & 1:
            if out is None:
                out, done = h, size
            else:
                k = min(len(out), len(h) - done)
                out, done = out[:k] * _power(size) + h[done : done + k], done + size
        n >>= 1
        if not n:
            return mixed(out)
        h, size = h[:-size] * _power(size) + h[size:], 2 * size


def _sliding(f: Callable, a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        a, size = f(a[:-size], a[size:]), 2 * size
    return f(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def anchors(symbols: np.ndarray, gram: int, window: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and the hashes of their grams.

    symbols may be several sequences one after another, then with the end of each; no window
    is taken across an end.
    """
    if len(symbols) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, w = gram_hashes(symbols, gram), window - gram + 1
    least = _sliding(np.minimum, h, w)
    if ends is not None:
        for e in ends[:-1].tolist():
            least[max(0, e - window + 1) : e] = 0
    edge = np.zeros(w - 1, np.uint64)
    most = _sliding(np.maximum, np.concatenate([edge, least, edge]), w)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def batches_of(texts: pa.Array, view: type) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(first row, views, their symbols one after another, ends) for runs of texts of about TOGETHER symbols."""
    views, parts, held, first = [], [], 0, 0
    for k, text in enumerate(texts):
        own = view(text.as_buffer().to_pybytes())
        views.append(own)
        parts.append(own.symbols())
        held += own.n
        if held >= TOGETHER:
            yield first, views, np.concatenate(parts), np.cumsum([v.n for v in views])
            views, parts, held, first = [], [], 0, k + 1
    if views:
        yield first, views, np.concatenate(parts), np.cumsum([v.n for v in views])


def _combined(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by (gram, document) without repeats, and whether several documents have the gram."""
    o = np.lexsort((doc, h))
    h, doc = h[o], doc[o]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    shared = np.repeat(np.diff(np.append(at, len(h))) > 1, np.diff(np.append(at, len(h))))
    return h, doc, shared


def _by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[pa.Array, pa.Array]:
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    data, ends = h.astype("<u8").tobytes(), np.append(at[1:], len(doc))
    grams = [data[8 * a : 8 * b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)] if len(at) else []
    return pa.array(doc[at], pa.int64()), pa.array(grams, pa.binary())


def shared_grams(docs: DataFrame, view: type, gram: int, window: int, buckets: int, again: bool = False) -> DataFrame:
    """(doc_id, grams): for each document the anchor grams that other documents have too.

    docs: (doc_id, text), no nulls. grams: binary, an array of 64-bit hashes; a document may
    have several rows. Hashes that collide add grams that are not shared and lose none. again:
    look for the anchors a second time rather than store them all (16 bytes each).
    """

    names = ["doc_id", "grams", "bucket", "data"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hs, ids, held = [], [], 0
        for batch in batches:
            docs_of = batch["doc_id"].to_numpy()
            for first, views, symbols, ends in batches_of(batch["text"], view):
                at, h = anchors(symbols, gram, window, ends)
                hs.append(h)
                ids.append(docs_of[first + np.searchsorted(ends, at, "right")])
                held += len(symbols)
                if held >= HELD:
                    yield _combined(np.concatenate(hs), np.concatenate(ids))
                    hs, ids, held = [], [], 0
        if hs:
            yield _combined(np.concatenate(hs), np.concatenate(ids))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, grams) of what is shared here, and rows (bucket, data) to ship: a document for each gram."""
        for h, doc, shared in own(batches):
            ids, grams = _by_doc(h[shared], doc[shared])
            yield pa.RecordBatch.from_arrays([ids, grams, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())], names)
            first = np.append(True, h[1:] != h[:-1]) if len(h) else shared
            h, doc = h[first], doc[first]
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            o = np.lexsort((doc, bucket))
            h, doc, bucket = h[o], doc[o], bucket[o]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            keys, data = [], []
            for k in range(buckets):
                a, b = cuts[k], cuts[k + 1]
                if b > a:
                    keys.append(k)
                    data.append(h[a:b].astype("<u8").tobytes() + doc[a:b].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, of = [], [], []
        for batch in batches:
            for k, data in zip(batch["bucket"].to_pylist(), batch["data"], strict=True):
                both = np.frombuffer(data.as_buffer(), "<u8").reshape(2, -1)
                hs.append(both[0])
                ids.append(both[1].view("<i8"))
                of.append(k)
        for k in sorted(set(of)):  # usually one
            h = np.concatenate([x for x, b in zip(hs, of, strict=True) if b == k])
            doc = np.concatenate([x for x, b in zip(ids, of, strict=True) if b == k])
            h, doc, shared = _combined(h, doc)
            data = h[shared].astype("<u8").tobytes()
            grams = [data[i : i + 8] for i in range(0, len(data), 8)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[shared], pa.int64()), pa.array(grams, pa.binary())], ["doc_id", "grams"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "doc_id long, grams binary, bucket long, data binary")
    dealt = dealt if again else staged(dealt, "grams")
    among = dealt.filter("bucket is not null").select("bucket", "data").repartition(buckets, "bucket").mapInArrow(meet, "doc_id long, grams binary")
    return dealt.filter("bucket is null").select("doc_id", "grams").unionByName(among)
