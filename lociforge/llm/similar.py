"""Texts with a Jaccard similarity of 4/5 or more over their shingles of five words, as an exact set join.

Two sets of at least that similarity share an element among the first n - ceil(4n/5) + 1 of
each, in any order that holds for all sets. Elements that one text has alone should come first,
so that texts which only share a passage never meet. How many texts have an element is
counted in two steps:

- Every text shows the least ``SHOWN`` of its shingles. If enough of them for its first ones
  are shown by no other text, it has no similar one and is done. Most texts are.
- Of the rest, the hard ones, all shingles are counted; their first ones are those that the
  fewest hard texts have, and of these only what several have can lead to another text.

Texts that share a first shingle are compared: each with the text of the least key that it
shares one with, then those that are still in different components with each other. Of a shingle that up to FEW
texts have these pairs are joined. The texts of those that more have go to tasks in blocks with their whole sets; a
task compares them with numpy and gives only links that join components. So rows grow with the
texts, not with their pairs, and no pair is left out.

A pair is judged by its sizes, then by parity sketches (a bit for each element of a set or
more, which says whether an odd number fell on it): two sets differ in as many elements as
their sketches in bits, at least. Few pairs are left by that, and only their whole sets move.

The fingerprints of simhash.py give further links beside these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.anchors import gram_hashes
from lociforge.llm.shared import lean, staged
from lociforge.llm.simhash import RADIUS, contracted, fingerprint, linked
from lociforge.llm.suffixes import names_of
from lociforge.llm.wordcache import slices

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Share of its shingles that a text shows at first, as a fraction.
SHOWN = (3, 10)
#: Shingles that a task holds before it ships them; documents of a task that have a shingle, from which on it ships one of them.
HELD, HOT = 1 << 20, 64
#: Texts of a token whose pairs are joined; texts of a block where more have one, and elements of a block of bits.
FEW, MEMBERS, COLUMNS = 8, 512, 1 << 13
#: Texts that are compared with each other because common tokens join them, at most; else token by token.
GROUP = 32 * MEMBERS
#: Rows up to which a list of texts is broadcast.
MAX_BROADCAST = 1_000_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def key_of(words: list[bytes]) -> int:
    """Names the sequence of words of a text, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted; fewer words than a shingle's are one, none are none."""
    if not words:
        return np.empty(0, np.uint64)
    symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(symbols, min(shingle, len(words))))


def n_first(n: np.ndarray | int):
    """How many first elements of a set of n: a similar set has one of them among its own."""
    num, den = LEAST
    return n - -(-num * n // den) + (n > 0)


def n_shown(n: int, share: tuple[int, int] = SHOWN) -> int:
    num, den = share
    return min(n, -(-num * n // den) + 2)


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted tokens begin, and for each token how long its run is."""
    at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
    size = np.diff(np.append(at, len(tokens)))
    return at, np.repeat(size, size)


def _shipped(rows: DataFrame, sets_of, buckets: int, hot: int) -> DataFrame:
    """Rows (bucket, data) of tokens that several texts may have, and (k, tokens, counts) of what is settled within a task.

    sets_of: gives (k, tokens) of the distinct texts of a batch. A token of ``hot`` or more texts of a task ships for
    one of them, whose count tells that. hot is 255 at most.
    """
    names = ["k", "tokens", "counts", "bucket", "data"]

    def flush(ks: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = [len(x) for x in sets]
        t, k = np.concatenate(sets), np.repeat(np.array(ks, np.int64), size)
        o = np.lexsort((k, t))
        t, k = t[o], k[o]
        at, n = _runs(t)
        many = n >= hot
        if many.any():
            yield from _by_text(t[many], k[many], n[many], names)
        first = np.zeros(len(t), bool)
        first[at] = True
        go = ~many | first
        t, k, n = t[go], k[go], np.where(many, n, 0)[go]
        bucket = (t >> np.uint64(20)) % np.uint64(buckets)
        o = np.argsort(bucket, kind="stable")
        t, k, n = t[o], k[o], n[o]
        cuts = np.searchsorted(bucket[o], np.arange(buckets + 1)).tolist()
        keys = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        n = np.minimum(n, hot).astype("u1")
        data = [t[i:j].astype("<u8").tobytes() + k[i:j].astype("<i8").tobytes() + n[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
        none = [pa.nulls(len(keys), kind) for kind in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, sets, held = [], [], 0
        for batch in batches:
            for k, own in sets_of(batch):
                ks.append(k)
                sets.append(own)
                held += len(own)
                if held >= HELD:
                    yield from flush(ks, sets)
                    ks, sets, held = [], [], 0
        if held:
            yield from flush(ks, sets)

    return rows.mapInArrow(lean(run), "k long, tokens binary, counts binary, bucket long, data binary")


def _by_text(t: np.ndarray, k: np.ndarray, n: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    if not len(k):
        return
    o = np.argsort(k, kind="stable")
    t, k, n = t[o].astype("<u8").tobytes(), k[o], np.minimum(n[o], 1 << 30).astype("<i4").tobytes()
    cuts = [*np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist(), len(k)]
    ends = list(zip(cuts, cuts[1:], strict=False))
    cols = [pa.array(k[cuts[:-1]]), pa.array([t[8 * a : 8 * b] for a, b in ends], pa.binary()), pa.array([n[4 * a : 4 * b] for a, b in ends], pa.binary())]
    yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(ends), kind) for kind in (pa.int64(), pa.binary())][: len(names) - 3]], names)


def _mixed(k: np.ndarray) -> np.ndarray:
    """Keys with their high bits brought low, so that buckets of them differ from those of tokens."""
    x = k.view(np.uint64)
    return x ^ (x >> np.uint64(33))


def _packed(k: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data), one for each bucket of keys k: columns there, one after the other."""
    bucket = (_mixed(k) % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    columns = [x[o] for x in columns]
    cuts = np.searchsorted(bucket[o], np.arange(buckets + 1)).tolist()
    ends = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
    data = [b"".join(x[i:j].tobytes() for x in columns) for _, i, j in ends]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in ends], pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> list[np.ndarray]:
    """The columns of _packed again, of all rows (bucket, data) of a task."""
    parts, width = [], sum(np.dtype(x).itemsize for x in kinds)
    for batch in batches:
        for x in batch["data"]:
            data, at, own = x.as_buffer(), 0, []
            m = len(data) // width
            for kind in kinds:
                own.append(np.frombuffer(data, kind, m, at))
                at += m * own[-1].itemsize
            parts.append(own)
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind) for i, kind in enumerate(kinds)]


def _counted(rows: DataFrame, sets_of, hot: int, numbers: bool = False) -> DataFrame:
    """(k, tokens, counts): for each text tokens that others have too and how many do; a text may have several rows, and a token two counts,
    of which all are right up to ``hot`` or at least that. numbers: (k, c) instead, c being how many tokens a row would have.

    What meets by token goes back to its texts packed by their buckets, a row for each two buckets and not for each text and
    bucket; so a text has one row of that, however many buckets there are.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, k, n = _unpacked(batches, ["<u8", "<i8", "u1"])
        o = np.lexsort((n, k, t))
        t, k, n = t[o], k[o], n[o]
        last = np.append((t[1:] != t[:-1]) | (k[1:] != k[:-1]), True) if len(t) else np.empty(0, bool)
        t, k, n = t[last], k[last], n[last].astype(np.int64)  # a text that several tasks have counts once
        at, size = _runs(t)
        total = np.repeat(np.add.reduceat(np.maximum(n, 1), at), size[at]) if len(at) else size
        several = total > 1
        if numbers:
            k, c = np.unique(k[several], return_counts=True)
            yield from _packed(k, [k, c.astype("<i8")], buckets)
        else:
            yield from _packed(k[several], [t[several], k[several], np.minimum(total[several], 1 << 30).astype("<i4")], buckets)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if numbers:
            k, c = _unpacked(batches, ["<i8", "<i8"])
            k, at = np.unique(k, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, c, len(k)).astype(np.int64))], ["k", "c"])
        else:
            t, k, n = _unpacked(batches, ["<u8", "<i8", "<i4"])
            yield from _by_text(t, k, n, ["k", "tokens", "counts"])

    dealt = _shipped(rows, sets_of, buckets, hot)  # run twice: stored, the tokens would be as large as the texts
    among = dealt.filter("bucket is not null").select("bucket", "data").repartition(buckets, "bucket").mapInArrow(lean(meet), "bucket long, data binary")
    among = among.repartition(buckets, "bucket").mapInArrow(lean(of_texts), "k long, c long" if numbers else "k long, tokens binary, counts binary")
    settled = dealt.filter("bucket is null").select("k", "tokens", "counts")
    return (settled.select("k", (F.length("tokens") / 8).cast("long").alias("c")) if numbers else settled).unionByName(among)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the elements of a set by their low bits: a power of two of bits, 64 at least, one for each element or more."""
    m = 1 << max(6, int(len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int) -> bool:
    """Whether sets of n elements together can be similar, by their sketches; the larger one is folded to the size of the other."""
    num, den = LEAST
    a, b = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    apart = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return (num + den) * apart <= (den - num) * n


_OWN = "doc_id long, h long, k long, fp long, n long, sketch binary"


def _slim(docs: DataFrame, text: str) -> DataFrame:
    """A row _OWN for each of docs, without its text. h is a hash of the text as it is, k one of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for x in part[text].to_pylist():
                    words = _words(x)
                    own = shingles(words)
                    rows.append((key_of(words), fingerprint(x, SHINGLE), len(own), sketch(own)))
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h"], *cols], ["doc_id", "h", "k", "fp", "n", "sketch"])

    return docs.select("doc_id", F.xxhash64(text).alias("h"), text).mapInArrow(lean(run), _OWN)


def _hard(docs: DataFrame, text: str, own: DataFrame) -> DataFrame:
    """(k, h) of the texts whose first shingles other texts may have, h being one text's with these words."""

    share = SHOWN

    def shown(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for x in batch[text].to_pylist():
            words = _words(x)
            if words:
                all_ = shingles(words)
                yield key_of(words), all_[: n_shown(len(all_), share)].copy()  # a view would hold the others too

    seen = _counted(docs.select(text), shown, HOT, numbers=True).groupBy("k").agg(F.sum("c").alias("c"))
    num, den = LEAST
    first = F.col("n") - F.ceil(F.lit(num) * F.col("n") / den) + 1
    show = F.least("n", F.ceil(F.lit(share[0]) * F.col("n") / share[1]) + 2)
    texts = own.filter("n > 0").groupBy("k").agg(F.first("n").alias("n"), F.min("h").alias("h"))
    return staged(texts.join(seen, "k").filter(show - F.col("c") < first).select("k", "h"), "hard")


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few enough; else a join shuffles it."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _hard_sets(docs: DataFrame, text: str, hard: DataFrame) -> DataFrame:
    """(k, own) of the hard texts: all shingles, sorted."""
    texts = docs.select(text, F.xxhash64(text).alias("h")).join(few(hard), "h").dropDuplicates(["k"])
    return staged(texts.select("k", _sets(F.col(text)).alias("own")), "sets")


def _shared(sets: DataFrame) -> DataFrame:
    """(token, k, n, centre) of the first shingles of hard texts that several of them have; centre is the least k there."""

    hot = HOT

    def whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for k, x in zip(batch["k"].to_pylist(), batch["own"], strict=True):
            yield k, np.frombuffer(x.as_buffer(), np.uint64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, x, counted in zip(batch["k"].to_pylist(), batch["own"], batch["counted"], strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                count = np.ones(len(own), np.int64)
                for part in counted:
                    at = np.searchsorted(own, np.frombuffer(part["tokens"].as_buffer(), "<u8"))
                    np.maximum.at(count, at, np.frombuffer(part["counts"].as_buffer(), "<i4"))
                o = np.lexsort((own, np.minimum(count, hot)))[: n_first(len(own))]  # counts are the same for all texts up to hot
                o = o[count[o] > 1]
                tokens.append(own[o])
                keys.append(np.full(len(o), k, np.int64))
                sizes.append(np.full(len(o), len(own), np.int64))
            cols = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))]
            yield pa.RecordBatch.from_arrays(cols, ["token", "k", "n"])

    counted = _counted(sets, whole, hot).groupBy("k").agg(F.collect_list(F.struct("tokens", "counts")).alias("counted"))
    rows = staged(sets.join(counted, "k").mapInArrow(lean(first), "token long, k long, n long"), "first")
    centres = rows.groupBy("token").agg(F.min("k").alias("centre"), F.max("k").alias("most")).filter("centre < most").drop("most")
    return staged(rows.join(centres, "token").select("token", "k", "n", "centre"), "shared")


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([may_be_similar(*x) for x in zip(a, b, n, strict=True)], dtype="bool")


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    num, den = LEAST

    def one(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return den * both >= num * (len(x) + len(y) - both)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(T.BinaryType())
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([shingles(_words(x)).tobytes() for x in part], dtype="object")


def _fits(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar."""
    num, den = LEAST
    return den * F.least(a, b) >= num * F.greatest(a, b)


def _verified(sets: DataFrame, slim: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of keys those of similar texts. slim: (k, n, sketch), sets: (k, own)."""
    a, b = (slim.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").filter(_fits("n_a", "n_b")).filter(_near("sketch_a", "sketch_b", F.col("n_a") + F.col("n_b")))
    near = staged(near.select("a", "b"), "near")
    a, b = (sets.select(F.col("k").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    return staged(near.join(a, "a").join(b, "b").filter(_similar("own_a", "own_b")).select("a", "b"), "links")


def similar_links(docs: DataFrame, text: str, own: DataFrame) -> DataFrame:
    """Links (a, b), b < a, of keys of texts: their closure joins all that are similar. own: _slim of docs."""
    hard = _hard(docs, text, own)
    sets = _hard_sets(docs, text, hard)
    slim = staged(own.join(few(hard.select("k")), "k", "left_semi").dropDuplicates(["k"]).select("k", "n", "sketch"), "sketches")
    shared = _shared(sets)

    one = shared.groupBy("k").agg(F.min("centre").alias("b")).filter("k > b").select(F.col("k").alias("a"), "b")
    links = _verified(sets, slim, one)
    parts = contracted(links).withColumnsRenamed({"a": "k", "b": "part"})
    rows = shared.join(parts, "k", "left").select("token", "k", "n", F.coalesce("part", "k").alias("part"))
    marks = [F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")]
    several = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("part").alias("_a"), F.max("part").alias("_b"), *marks).filter("_a < _b")
    several = several.groupBy("c", "x", "y").agg(F.min("token").alias("token"))  # of shingles that the same texts have one does
    left = staged(rows.join(several.select("token", "c"), "token"), "left")  # what shares a first shingle across components
    few_, many = left.filter(F.col("c") <= FEW), _gathered(left.filter(F.col("c") > FEW).select("token", "k", "part", "c"))
    other = few_.select("token", F.col("k").alias("b"), F.col("n").alias("_n"), F.col("part").alias("_part"))
    both = few_.join(other, "token").filter("k > b and part != _part").filter(_fits("n", "_n")).select(F.col("k").alias("a"), "b").distinct()
    return links.union(_verified(sets, slim, both)).union(_among_many(many, sets))


def _gathered(left: DataFrame, most: int | None = None) -> DataFrame:
    """(name, k, part, c): groups in which texts of common tokens, left (token, k, part, c), are to be compared, and their sizes.

    A text mostly has many tokens in common with the same others, so texts that tokens join, however far, are one group,
    with which a text goes once; but the tokens of groups of over ``most`` texts are groups themselves.
    """
    stars = left.join(left.groupBy("token").agg(F.min("k").alias("b")), "token").filter("k > b").select(F.col("k").alias("a"), "b").distinct()
    roots = contracted(stars).withColumnsRenamed({"a": "k", "b": "root"})
    rows = staged(left.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "groups")
    own = rows.select("root", "k", "part").distinct()
    sizes = own.groupBy("root").agg(F.count("*").alias("size"))
    fits = F.col("size") <= (most or GROUP)
    whole = own.join(sizes, "root").filter(fits).select(F.col("root").alias("name"), "k", "part", F.col("size").alias("c"))
    return whole.union(rows.join(sizes, "root").filter(~fits).select(F.col("token").alias("name"), "k", "part", "c"))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share, from bits or from lists of those that have an element, whichever is less work."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    kept = count[at] > 1
    row, at = row[kept], (np.cumsum(count > 1) - 1)[at[kept]]
    count = count[count > 1].astype(np.int64)
    both = np.zeros((m, m), np.int32)
    if m * m * len(count) / 64 < 8 * (count * count).sum():
        for a in range(0, len(count), COLUMNS):
            own = np.zeros((m, min(COLUMNS, -(-(len(count) - a) // 64) * 64)), np.uint8)
            here = (at >= a) & (at < a + COLUMNS)
            own[row[here], at[here] - a] = 1
            bits = np.packbits(own, axis=1).view(np.uint64)
            for i in range(m):
                both[i] += np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int32)
        return both
    order = np.argsort(at, kind="stable")
    holders, start = row[order], np.cumsum(count) - count
    for i in range(m):
        own = at[row == i]
        n = count[own]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        both[i] = np.bincount(holders[places], minlength=m)
    return both


def joining(keys: np.ndarray, parts: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of similar sets that join different parts, no more than needed: one fewer than the parts they join.

    side: 0 all are compared with each other; 1 and 2 the ones with the others.
    """
    num, den = LEAST
    n, both = np.array([len(x) for x in sets]), common(sets)
    part, links = parts.copy(), []
    for i in range(len(sets)):
        near = den * both[i] >= num * (n + n[i] - both[i])
        near &= (part != part[i]) & ((side != side[i]) | (side == 0))
        for j in np.flatnonzero(near).tolist():
            if part[j] != part[i]:
                links.append((int(max(keys[i], keys[j])), int(min(keys[i], keys[j]))))
                part[part == part[j]] = part[i]
    return links


def _among_many(left: DataFrame, sets: DataFrame, members: int | None = None) -> DataFrame:
    """Links of the texts of groups, left (name, k, part, c): blocks of the texts of a group are compared in tasks.

    A task has the whole sets of two blocks, or of one, and gives only links that join components, so the rows
    are as many as the texts, not as their pairs; a group of more texts goes to more tasks.
    """
    members = members or MEMBERS
    n = F.ceil(F.col("c") / members).cast("int")
    rows = left.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("k"), "_n").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    name = F.xxhash64("name", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("name")  # two that clash are compared together
    rows = rows.select(name, side.alias("side"), "k", "part").join(sets, "k")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in names_of((x.select(["name", "side", "k", "part", "own"]) for x in batches), least=64):
            name, side, k, part = (b[c].to_numpy().astype(np.int64) for c in ("name", "side", "k", "part"))
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["own"]]
            cuts = [*np.flatnonzero(np.append(True, name[1:] != name[:-1])).tolist(), len(name)]
            links = [x for i, j in zip(cuts, cuts[1:], strict=False) if (part[i:j] != part[i]).any() for x in joining(k[i:j], part[i:j], side[i:j], own[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "name").sortWithinPartitions("name").mapInArrow(lean(search), "a long, b long")
    return staged(rows.distinct(), "links")


def one_of_similar(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Linked are texts of the same words, those with a similarity of 4/5 or more over shingles
    of five words, and those whose fingerprints differ in ``radius`` bits at most. Case and
    white space don't count. Null and empty texts are alike; a component without ids keeps
    one row, as do repeated rows; an empty table gives an empty result.
    """
    own = staged(_slim(docs, text), "similar")
    prints = staged(own.groupBy("fp").agg(F.min("k").alias("least")), "fps")
    same = own.select("fp", "k").distinct().join(prints, "fp").filter("k > least").select(F.col("k").alias("a"), F.col("least").alias("b"))
    trees = linked(prints.select("fp"), radius)
    a, b = prints.select(F.col("fp").alias("a"), F.col("least").alias("_a")), prints.select(F.col("fp").alias("b"), F.col("least").alias("_b"))
    trees = trees.join(a, "a").join(b, "b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))
    links = similar_links(docs, text, own).union(same).union(trees).filter("a > b").distinct()
    stars = contracted(links).withColumnsRenamed({"a": "k", "b": "root"})
    rows = own.select("doc_id", "h", "k").join(stars, "k", "left").select("doc_id", "h", F.coalesce("root", "k").alias("root"))
    rows = staged(rows, "rooted")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = rows.groupBy("root").agg(F.min(least).alias("first"))
    gone = rows.join(firsts, "root").filter(least != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = staged(gone, "gone")
    kept = docs.join(few(gone), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left_anti")
    if not rows.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():  # rows that are alike in doc_id and text
        kept = kept.withColumn("_h", F.xxhash64(text)).dropDuplicates(["doc_id", "_h"])
    return kept.select(*docs.columns)
