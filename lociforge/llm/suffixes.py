"""Exact substring dedup by distributed prefix doubling over sampled suffixes.

A byte is removed if a string of ``window`` bytes that covers it also starts in a document
with a smaller doc_id. Copies of a whole text are settled by their hash; the distinct texts
lie in a table bucketed by doc_id, which every round and the result read without moving it.

The suffixes are those at anchors (see anchors.py), each standing for the windows around it.
A round names the first bytes of every suffix that is left, at growing lengths (20, 35, 47
and 50 bytes, each at the offset where the windows that it stands for overlap), and Spark
sorts (name, surroundings, document, position). Along that order

- a name that one document has alone is dropped: its windows are unique;
- rows of a name that agree on all that their windows cover are settled: each but those of
  the smallest document repeats it;
- of the rest one row for each of the surroundings goes on. Up to ``MOST`` of a name are
  finished where they meet, by naming and sorting their windows; a name with more is split
  in parts with longer names for the next round.

The last names are whole windows, so nothing is left. A task settles what its own documents
share before it ships anything; rows meet by name and surroundings, never by a common name
alone; and a task holds no more than ``MOST`` passages of a name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.llm.anchors import HELD as TOGETHER
from lociforge.llm.anchors import anchors, batches_of, gram_hashes, mixed, shared_grams
from lociforge.llm.shared import new_folder, staged

WINDOW, GRAM = 50, 20
#: k = _k in a form that is no key of a join, so that bucketed texts stay where they are.
SAME_K = "(k ^ _k) = 0"
#: Passages of a name that a task finishes at once.
MOST = 1 << 16
_EMPTY = hashlib.sha256(b"").digest()


def parts_of(window: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each round the parts of a suffix: (least, greatest) distance of a window's start before the anchor."""
    whole = window - gram
    rounds, parts = [[(0, whole)]], [(0, whole)]
    while any(b > a for a, b in parts):
        n = 2 if len(rounds) == 1 else 4
        new = []
        for a, b in parts:
            cuts = sorted({a + (b - a + 1) * i // n for i in range(n + 1)})
            new += [(x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False)]
        parts = new
        rounds.append(parts)
    return rounds


#: A number for each byte, so that sums of products of them tell strings apart.
_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64))


class Bytes:
    """A text as its bytes."""

    def __init__(self, text: bytes):
        self.text, self.n = text, len(text)

    def symbols(self) -> np.ndarray:
        return _NUMBERS[np.frombuffer(self.text, np.uint8)]

    def cut(self, a: int, b: int) -> bytes:
        return self.text[a:b]


class Words:
    """A text as its words, which ASCII white space parts; a run of them is joined by single spaces."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.n = len(self.words)

    def symbols(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, self.n)

    def cut(self, a: int, b: int) -> bytes:
        return b" ".join(self.words[a:b])


def slim(docs: DataFrame, n: Callable[[Column], Column], kept: Column) -> DataFrame:
    """A small row for each document: n of, and the hash of, what is kept if nothing is removed.

    A null text counts as empty. k1 and k2 are hashes of the text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", kept.alias("kept")).select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("k2"), "text").alias("k2"),
        n(F.col("kept")).cast("long").alias("n"), F.unhex(F.sha2("kept", 256)).alias("sha256"),
    )
    return staged(rows, "slim")


def firsts(rows: DataFrame, least: int) -> DataFrame:
    """The distinct texts of slim rows: k1, k2, their least doc_id, and k, which tells apart texts of one doc_id."""
    own = rows.filter((F.col("n") >= least) & F.col("doc_id").isNotNull())
    own = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2")) - 1)


def bucketed_texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The texts of ``first``, bucketed by doc_id in the shared folder: (doc_id, k, k1, k2, text)."""
    spark = docs.sparkSession
    text = docs.select("doc_id", "text").filter("text is not null and doc_id is not null")
    rows = text.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("k2"), F.col("text")))
    rows = rows.dropDuplicates(["doc_id", "k1", "k2"]) if _repeated(first, docs) else rows
    n = buckets_of(spark)
    name = f"texts_{uuid.uuid4().hex}"
    # joined on the bucket's key alone, so that each task holds one bucket and writes one file; an
    # equality of columns would become a key too
    own = first.select("doc_id", "k", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).repartition(n, "doc_id")
    kept = rows.repartition(n, "doc_id").join(own, "doc_id").filter("(k1 ^ _k1) = 0 and (k2 ^ _k2) = 0")
    writer = kept.select("doc_id", "k", "k1", "k2", "text").write.bucketBy(n, "doc_id").format("parquet")
    writer.option("path", new_folder(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)  # which knows its files and buckets, so the name can go
    spark.sql(f"drop table {name}")
    return texts


def _repeated(first: DataFrame, docs: DataFrame) -> bool:
    ids = docs.filter("doc_id is not null")
    return ids.count() > ids.select("doc_id").distinct().count()


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_NAMED = "name long, around long, doc_id long, k int, at int, part int, local boolean"


def _settled_here(name: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows that agree with one of a smaller document on all that their windows cover."""
    o = np.lexsort((doc, around, name))
    new = np.append(True, (name[o][1:] != name[o][:-1]) | (around[o][1:] != around[o][:-1]))
    run = np.flatnonzero(new)
    least = np.repeat(doc[o][run], np.diff(np.append(run, len(o))))
    out = np.empty(len(o), bool)
    out[o] = doc[o] > least
    return out


def named(texts: DataFrame, todo: DataFrame, parts: list[tuple[int, int]], gram: int, window: int, view: type) -> DataFrame:
    """Rows _NAMED for each part of the suffixes in todo.

    Rows that a task can settle among its own documents are local: their names are replaced
    by any number, so that they don't crowd where a common name is dealt with.
    """
    first = "grams" in todo.columns

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        held, size = [], 0

        def out():
            name, around, doc, k, at, part = (np.concatenate([x[i] for x in held]) for i in range(6))
            local = _settled_here(name, around, doc)
            with np.errstate(over="ignore"):
                name = np.where(local, mixed(around ^ doc.view(np.uint64) ^ at.astype(np.uint64)), name)
            cols = [name.view(np.int64), around.view(np.int64), doc, k, at, part, local]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "around", "doc_id", "k", "at", "part", "local"])

        def rows_of(own, doc, k, at, part, names):
            cut, far, near, n = own.cut, part[1], part[2], own.n
            lo = np.maximum(0, at - far)
            hi = np.minimum(n, at - near + window)
            around = [digest(cut(a, b), c) for a, b, c in zip(lo.tolist(), hi.tolist(), (at - near - lo).tolist(), strict=True)]
            m = len(at)
            held.append((names, np.array(around, np.uint64), np.full(m, doc, np.int64), np.full(m, k, np.int32), at.astype(np.int32), part[0].astype(np.int32)))

        for batch in batches:
            docs, ks, left = batch["doc_id"].to_pylist(), batch["k"].to_pylist(), batch["left"]
            starts, items = left.offsets.to_numpy(), left.values
            if first:
                for row, views, symbols, ends in batches_of(batch["text"], view):
                    at, h = anchors(symbols, gram, window, ends)
                    cuts = np.searchsorted(at, np.append(0, ends))
                    for i, own in enumerate(views):
                        b, e = cuts[i], cuts[i + 1]
                        wanted = np.frombuffer(b"".join(items[int(starts[row + i]) : int(starts[row + i + 1])].to_pylist()), "<u8")
                        here = np.flatnonzero(np.isin(h[b:e], wanted)) + b
                        p = at[here] - (ends[i - 1] if i else 0)
                        none = np.zeros(len(p), np.int64)
                        rows_of(own, docs[row + i], ks[row + i], p, (none, none + parts[0][1], none + parts[0][0]), h[here])
                        size += own.n
            else:
                places, children = items.field("at").to_numpy().astype(np.int64), items.field("child").to_numpy().astype(np.int64)
                bounds = np.array(parts, np.int64)
                for i, text in enumerate(batch["text"]):
                    own = view(text.as_buffer().to_pybytes())
                    both = np.unique(np.stack([places[starts[i] : starts[i + 1]], children[starts[i] : starts[i + 1]]], 1), axis=0)
                    near, far = bounds[both[:, 1], 0], bounds[both[:, 1], 1]
                    fits = (both[:, 0] - near >= 0) & (both[:, 0] - far + window <= own.n)
                    at, part, near, far = both[fits, 0], both[fits, 1], near[fits], far[fits]
                    names = np.array([digest(own.cut(a, b)) for a, b in zip((at - near).tolist(), (at - far + window).tolist(), strict=True)], np.uint64)
                    rows_of(own, docs[i], ks[i], at, (part, far, near), names)
                    size += own.n
            if size >= TOGETHER:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    if first:
        lists = todo.groupBy("doc_id").agg(F.collect_list("grams").alias("left"))
        rows = texts.join(lists, "doc_id")
    else:
        lists = todo.groupBy("doc_id", "k").agg(F.collect_list(F.struct("at", "child")).alias("left"))
        rows = texts.join(lists.withColumnRenamed("k", "_k"), "doc_id").filter(SAME_K)
    return rows.select("doc_id", "k", "text", "left").mapInArrow(suffixes, _NAMED)


def ranked(rows: DataFrame) -> DataFrame:
    """(name, doc_id, k, at, part, settled): settled are rows that a smaller document has with the same surroundings.

    Rows meet by name and surroundings, so a common name is spread over many tasks; of equal
    surroundings only one row of each run of a task's documents comes here.
    """
    least = F.min("doc_id").over(Window.partitionBy("name", "around"))
    return rows.select("name", "doc_id", "k", "at", "part", (F.col("local") | (F.col("doc_id") > least)).alias("settled"))


def going(ranks: DataFrame, most: int) -> DataFrame:
    """(name, doc_id, k, at, part, many) of unsettled rows whose name several documents have; many: of a name with over ``most``."""
    left = ranks.filter("not settled").drop("settled")
    names = left.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    names = names.filter("a < b").select("name", (F.col("n") > most).alias("many"))
    return left.join(names, "name")


def children_of(rounds: list[list[tuple[int, int]]], r: int) -> Column:
    """The parts of the next round that a row's part of round r is split into."""
    inside = [[i for i, (a, b) in enumerate(rounds[r + 1]) if a >= x and b <= y] for x, y in rounds[r]]
    return F.get(F.array(*[F.array(*[F.lit(i) for i in own]) for own in inside]), F.col("part"))


def settled_of(ranked: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    at = F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("greatest")) for a, b in parts])
    rows = ranked.filter("settled").select("doc_id", "k", "at", F.get(at, F.col("part")).alias("p"))
    return rows.select("doc_id", "k", "at", "p.*")


def passages(texts: DataFrame, rows: DataFrame, parts: list[tuple[int, int]], window: int, view: type) -> DataFrame:
    """(name, doc_id, k, at, part, begin, passage) of the rows (name, doc_id, k, at, part): all that their windows cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(parts, np.int64)
        for batch in batches:
            left = batch["left"]
            starts, items = left.offsets.to_numpy(), left.values
            at, part = items.field("at").to_numpy().astype(np.int64), items.field("part").to_numpy()
            begin, end = np.maximum(0, at - bounds[part, 1]), at - bounds[part, 0] + window
            own = []
            for i, text in enumerate(batch["text"]):
                v = view(text.as_buffer().to_pybytes())
                a, b = starts[i], starts[i + 1]
                own += [v.cut(x, y) for x, y in zip(begin[a:b].tolist(), np.minimum(end[a:b], v.n).tolist(), strict=True)]
            n = np.diff(starts)
            lo, hi = starts[0], starts[-1]
            cols = [
                items.field("name")[lo:hi], pa.array(np.repeat(batch["doc_id"].to_numpy(), n)), pa.array(np.repeat(batch["k"].to_numpy(), n)),
                items.field("at")[lo:hi], items.field("part")[lo:hi], pa.array(begin[lo:hi].astype(np.int32)), pa.array(own, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["name", "doc_id", "k", "at", "part", "begin", "passage"])

    lists = rows.groupBy("doc_id", F.col("k").alias("_k")).agg(F.collect_list(F.struct("name", "at", "part")).alias("left"))
    both = texts.join(lists, "doc_id").filter(SAME_K).select("doc_id", "k", "text", "left")
    return both.mapInArrow(cut, "name long, doc_id long, k int, at int, part int, begin int, passage binary")


def _windows_again(name: np.ndarray, doc: np.ndarray, shift: np.ndarray, own: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): runs of window starts in passages, sorted by (name, document), that a smaller document of the name has.

    Windows are named by doubling and sorted with the name and their place beside the anchor.
    """
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    data = np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    size = np.maximum(0, np.diff(offsets) - window + 1)
    row = np.repeat(np.arange(len(own)), size)
    start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    h = gram_hashes(_NUMBERS[data], window)[offsets[row] + start] if len(row) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        key = mixed(h ^ mixed(name[row].view(np.uint64) + (start - shift[row]).astype(np.uint64)))
    o = np.argsort(key, kind="stable")  # rows are in order of document
    new = np.flatnonzero(np.append(True, key[o][1:] != key[o][:-1])) if len(o) else o
    least = np.repeat(doc[row[o[new]]], np.diff(np.append(new, len(o))))
    again = np.zeros(len(row), bool)
    again[o] = doc[row[o]] > least
    at = np.flatnonzero(again)
    row, start = row[at], start[at]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(at) else at
    last = np.append(first[1:], len(at)) - 1 if len(at) else at
    return row[first], start[first], start[last]


def names_of(batches: Iterator[pa.RecordBatch], least: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Batches of whole names, of ``least`` rows or more but for the last, from rows in order of name."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= least:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name = whole["name"].to_numpy()
            tail = int(np.searchsorted(name, name[-1]))
            if tail:
                yield whole.slice(0, tail)
            held = [whole.slice(tail)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def finished(own: DataFrame, window: int) -> DataFrame:
    """(doc_id, k, first, last): runs of window starts that smaller documents have, of passages sorted by (name, doc_id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in names_of(x.select(["name", "doc_id", "k", "at", "begin", "passage"]) for x in batches):
            begin, at = b["begin"].to_numpy(), b["at"].to_numpy()
            pick, first, last = _windows_again(b["name"].to_numpy(), b["doc_id"].to_numpy(), at - begin, b["passage"], window)
            cols = [b[c].take(pa.array(pick)) for c in ("doc_id", "k")]
            runs = [pa.array(begin[pick] + x, pa.int32()) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([*cols, *runs], ["doc_id", "k", "first", "last"])

    return own.mapInArrow(scan, "doc_id long, k int, first int, last int")


def repeats(texts: DataFrame, window: int, gram: int, most: int = MOST) -> DataFrame:
    """(doc_id, k, first, last): runs of window starts whose windows are in a smaller document."""
    n = buckets_of(texts.sparkSession)
    rounds = parts_of(window, gram)
    todo = shared_grams(texts, Bytes, gram, window, n, again=True)  # an anchor for 16 bytes: stored, they'd be as large as the texts
    found = None
    for r, parts in enumerate(rounds):
        ranks = staged(ranked(named(texts, todo, parts, gram, window, Bytes)), f"ranks{r}")
        own = settled_of(ranks, parts).select("doc_id", "k", F.greatest(F.col("at") - F.col("greatest"), F.lit(0)).alias("first"), (F.col("at") - F.col("least")).alias("last"))
        found = own if found is None else found.unionByName(own)
        if r + 1 == len(rounds):
            break  # these names are windows; rows of one agree
        left = staged(going(ranks, most), f"left{r}")
        own = passages(texts, left.filter("not many"), parts, window, Bytes).repartition(n, "name").sortWithinPartitions("name", "doc_id")
        found = found.unionByName(staged(finished(own, window), f"runs{r}"))
        todo = left.filter("many").select("doc_id", "k", "at", F.explode(children_of(rounds, r)).alias("child"))
        if todo.isEmpty():
            break
    return found


def removed_mask(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of n places lie in a window that starts in one of the runs."""
    last = np.minimum(last, n - window)
    ok = last >= first
    edge = np.bincount(first[ok], minlength=n + 1) - np.bincount(last[ok] + window, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text).

    kept: the remaining bytes, null where all or none are left. Null texts are empty; texts
    under ``window`` bytes stay whole; a null doc_id is smaller or greater than none, so its
    text stays and removes nothing; of equal texts the one with the smallest doc_id counts,
    and rows that share a doc_id never remove each other's bytes. An empty table gives an
    empty result.
    """
    rows = slim(docs, F.octet_length, F.col("text"))
    first = staged(firsts(rows, window), "firsts")
    texts = bucketed_texts(docs, first)
    spans = repeats(texts, window, gram).groupBy("doc_id", "k").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            starts, runs_of = batch["spans"].offsets.to_numpy(), batch["spans"].values
            first, last = runs_of.field("first").to_numpy(), runs_of.field("last").to_numpy()
            for i, text in enumerate(batch["text"]):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                mask = removed_mask(len(raw), first[starts[i] : starts[i + 1]], last[starts[i] : starts[i + 1]], window)
                kept = raw[~mask].tobytes()
                runs = int(mask[0]) + int((np.diff(mask.astype(np.int8)) == 1).sum())
                out.append((int(mask.sum()), runs, hashlib.sha256(kept).digest(), kept))
            cols = [batch["k1"], batch["k2"], batch["doc_id"]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            cols += [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "first", "n_removed", "n_spans", "kept_sha", "kept"])

    changed = texts.join(spans.withColumnRenamed("k", "_k"), "doc_id").filter(SAME_K).select("k1", "k2", "doc_id", "text", "spans")
    changed = changed.mapInArrow(cut, "k1 long, k2 long, first long, n_removed long, n_spans long, kept_sha binary, kept binary")
    return results(rows, first, changed).withColumnRenamed("n", "n_bytes")


def results(rows: DataFrame, first: DataFrame, changed: DataFrame) -> DataFrame:
    """One row per slim row: copies lose all, first texts what ``changed`` says, others nothing."""
    own = rows.join(first.select("k1", "k2", F.col("doc_id").alias("first")), ["k1", "k2"], "left")
    copy = F.col("first").isNotNull() & (F.col("doc_id") > F.col("first"))
    own = own.withColumn("copy", F.coalesce(copy, F.lit(False)))
    cut = F.when(~F.col("copy"), F.col("first"))
    own = own.withColumn("first", F.when(F.col("doc_id").isNotNull(), cut)).join(changed, ["k1", "k2", "first"], "left")
    n = F.col("n")
    pick = lambda yes, name, no: F.when(F.col("copy"), yes).otherwise(F.coalesce(name, no))
    return own.select(
        "doc_id", "n",
        pick(n, "n_removed", F.lit(0)).alias("n_removed"), pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(pick(F.lit(_EMPTY), "kept_sha", F.col("sha256")))).alias("kept_sha256"), "kept",
    )
