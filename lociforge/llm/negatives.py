"""Hard negatives of anchors, exact, found with a table of pivot distances.

Vectors become whole numbers. With one more component, sqrt(M - |x|^2) for the greatest
squared length M, all rows lie at one distance from the origin, and an anchor's inner product with a
row falls as their Euclidean distance grows. The distances of every row to a few pivots are
taken; by the triangle inequality they bracket its distance to an anchor, and so its score.
Rows are stored in pages of near ones. Tasks hold a block of anchors with the best rows found for them and read a
share of all pages: anchors to which a page's brackets leave no hope skip it, the others are multiplied with it exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

#: Pivots, and rows of the sample from which they are taken: each is far from those before it.
PIVOTS, PIVOT_SAMPLE = 16, 4096
#: Rows of a page, pages beyond which pages get larger instead, and rows of the sample for each leaf of the tree that orders the rows.
PAGE, PAGES, A_LEAF = 2048, 32_768, 16
#: Anchors of a task and numbers in their vectors at most, anchors whose scores of a page are held at once.
ANCHORS, NUMBERS, BLOCK = 32_768, 1 << 22, 128
#: Tasks for each core, and bytes of pages (at 16 bits a number) that a task reads at most.
TASKS, READ = 4, 1 << 26
#: Components are whole parts of the vector's by so much.
SCALE = 256.0
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_WISHES = "array<struct<w:int,same:boolean,low:bigint,high:bigint,k:int>>"
_FOUND = T.StructType([
    T.StructField("anchor_id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("w", T.IntegerType()),
    T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("twin", T.BooleanType()),
])
_PAGES = T.StructType([
    T.StructField("page", T.LongType()), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
    T.StructField("ids", T.BinaryType()), T.StructField("labels", T.BinaryType()), T.StructField("bits", T.IntegerType()),
    T.StructField("rows", T.BinaryType()),
])


def _matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows, short ones filled with zeros."""
    out = np.zeros((len(vecs), dim), np.int64)
    sizes = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(vecs)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Pivots in the space with one more component. most: the greatest squared length of a row."""

    def __init__(self, points: np.ndarray, most: int):
        # squared lengths bound every sum of products of two rows: below these, inner products are exact as floats or doubles
        self.most, self.kind = most, np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
        self.slack = 1e-6 * np.sqrt(most) + 1e-9
        x = points.astype(float)
        self.points, self.norm, self.last = x, (x * x).sum(1), self._last((x * x).sum(1))

    def _last(self, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - norm, 0))

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        x = rows.astype(float)
        inner = x @ self.points.T + self._last((x * x).sum(1))[:, None] * self.last
        return np.sqrt(np.maximum(2 * self.most - 2 * inner, 0))

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose further component is 0, to the pivots."""
        x = anchors.astype(float)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.most - 2 * x @ self.points.T, 0))

    def distance(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance between an anchor of this squared length and a row of this score."""
        return np.sqrt(np.maximum(norm + self.most - 2.0 * score, 0))


def choose_pivots(sample: np.ndarray, most: int, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, the longest first, then always the one farthest from those chosen."""
    best = [int(np.argmax((sample.astype(float) ** 2).sum(1)))]
    near = Space(sample[best], most).of_rows(sample)[:, 0]
    while len(best) < min(n, len(sample)) and near.max() > 0:
        best.append(int(near.argmax()))
        near = np.minimum(near, Space(sample[best[-1:]], most).of_rows(sample)[:, 0])
    return sample[best]


def grow(dists: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete tree in heap order: (pivot, median) of each inner node, split where the distances spread most."""
    nodes, level = [], [dists]
    for _ in range(depth):
        below = []
        for own in level:
            k = int(own.std(0).argmax()) if len(own) else 0
            cut = float(np.median(own[:, k])) if len(own) else 0.0
            nodes.append((k, cut))
            below += [own[own[:, k] <= cut], own[own[:, k] > cut]]
        level = below
    return nodes


def leaves_of(dists: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(dists), np.int64)
    if nodes:
        pivot, cut = np.array([k for k, _ in nodes]), np.array([c for _, c in nodes])
        for _ in range((len(nodes) + 1).bit_length() - 1):
            at = 2 * at + 1 + (dists[np.arange(len(at)), pivot[at]] > cut[at])
    return at - len(nodes)


def whole_numbers(rows: DataFrame, anchors: Column, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, anchor, vec, norm) of the rows that take part."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(finite)
    rows = rows.withColumn("vec", F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))).drop("v")
    return rows.withColumn("norm", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x))  # fails beyond a long


def paged(own: DataFrame, space: Space, dim: int, nodes: list[tuple[int, float]], size: int) -> DataFrame:
    """Pages of rows that are near each other, with the least and greatest of their distances to each pivot."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(space.of_rows(_matrix(batch["vec"], dim)), nodes)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["vec"], pa.array(leaf, pa.int64())], ["vec_id", "label", "vec", "leaf"])

    def page(number: int, ids: list[np.ndarray], labels: list[np.ndarray], vecs: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(vecs)
        dists = space.of_rows(rows)
        top = int(max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))))
        bits = 16 if top < 1 << 15 else 32 if top < 1 << 31 else 64
        cols = [[number], [dists.min(0)], [dists.max(0)], [np.concatenate(ids).tobytes()], [np.concatenate(labels).tobytes()], [bits], [rows.astype(f"<i{bits // 8}").tobytes()]]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _PAGES.names)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, leaf = TaskContext.get().partitionId() << 32, [], None
        for batch in batches:
            leaves = batch["leaf"].to_numpy()
            ids, labels, vecs = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["vec"], dim)
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    n = sum(len(x[0]) for x in held)
                    if held and (leaves[a] != leaf or n == size):
                        yield page(number, *zip(*held, strict=True))
                        number, held, n = number + 1, [], 0
                    leaf, end = leaves[a], min(b, a + size - n)
                    held.append((ids[a:end], labels[a:end], vecs[a:end]))
                    a = end
        if held:
            yield page(number, *zip(*held, strict=True))

    rows = own.select("vec_id", "label", "vec").mapInArrow(dealt, "vec_id long, label long, vec array<long>, leaf long")
    rows = rows.repartitionByRange("leaf", F.xxhash64("vec_id", "vec")).sortWithinPartitions("leaf")  # many rows of one leaf are several tasks
    return rows.mapInArrow(pages, _PAGES)


class _Held:
    """Anchors of a task, their wishes and the best rows found for each so far."""

    def __init__(self, parts: list[pa.RecordBatch], space: Space, dim: int):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        whole = whole.take(pa.array(np.argsort(whole["label"].to_numpy(), kind="stable")))
        self.space, self.x = space, _matrix(whole["vec"], dim)
        self.ids, self.copies, self.labels = (whole[c].to_numpy() for c in ("anchor_id", "copy", "label"))
        self.q, self.norm, self.y = space.of_anchors(self.x), (self.x.astype(float) ** 2).sum(1), self.x.astype(space.kind)
        flat, sizes = whole["wishes"].flatten(), np.diff(whole["wishes"].offsets.to_numpy())
        self.at = np.repeat(np.arange(len(whole)), sizes)
        self.w, self.same, self.floor, self.high, self.k = (flat.field(c).cast(pa.int64()).to_numpy(zero_copy_only=False).copy() for c in ("w", "same", "low", "high", "k"))
        if space.kind is not np.int64:  # no score lies outside, and these are exact in the scores' type
            self.floor, self.high = np.clip(self.floor, -space.most - 1, space.most + 1), np.clip(self.high, -space.most - 1, space.most + 1)
        self.slot = np.full((len(whole), int(sizes.max(initial=0))), -1)
        self.slot[self.at, np.arange(len(self.at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.arange(len(self.at))
        shape = (len(self.at), int(self.k.max(initial=1)))
        self.n, self.score, self.row, self.twin = np.zeros(len(self.at), np.int64), np.full(shape, LEAST), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def see(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Judges the rows of a page whose distances to the pivots lie from low to high."""
        near, far = np.maximum(low - self.q, self.q - high).max(1)[self.at], (self.q + high).min(1)[self.at]
        norm, slack = self.norm[self.at], self.space.slack
        goes = (near <= self.space.distance(norm, self.floor.astype(float)) + slack) & (far >= self.space.distance(norm, self.high.astype(float)) - slack)
        order = np.lexsort((ids, labels))
        ids, labels, rows = ids[order], labels[order], rows[order].astype(self.space.kind)
        for same in (0, 1):
            going = np.unique(self.at[goes & (self.same == same)])
            if same:  # anchors meet the rows of their label
                for label in np.intersect1d(self.labels[going], labels).tolist():
                    a, b = np.searchsorted(labels, [label, label + 1])
                    own = going[np.searchsorted(self.labels[going], label) : np.searchsorted(self.labels[going], label, "right")]
                    for k in range(0, len(own), BLOCK):
                        self._judge(own[k : k + BLOCK], same, goes, ids[a:b], labels[a:b], rows[a:b])
            else:
                for k in range(0, len(going), BLOCK):
                    self._judge(going[k : k + BLOCK], same, goes, ids, labels, rows)

    def _judge(self, own: np.ndarray, same: int, goes: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        score = self.y[own] @ rows.T
        none = LEAST if self.space.kind is np.int64 else -np.inf
        if not same:
            for label in np.unique(self.labels[own]).tolist():
                i, j = np.searchsorted(self.labels[own], [label, label + 1]), np.searchsorted(labels, [label, label + 1])
                score[i[0] : i[1], j[0] : j[1]] = none
        slot = self.slot[own]
        slot = np.where((slot >= 0) & goes[slot] & (self.same[slot] == same), slot, -1)
        low = np.where(slot >= 0, self.floor[slot], MOST)
        high = np.where(slot >= 0, self.high[slot], LEAST)
        kind = lambda x: x.astype(self.space.kind)
        hit = lambda: (score >= kind(low.min(1))[:, None]) & (score <= kind(high.max(1))[:, None])
        hits = hit()
        if np.count_nonzero(hits) > 32 * np.count_nonzero(slot >= 0):  # the k-th best of this page is the least that counts
            for c in range(slot.shape[1]):
                i = np.flatnonzero((slot[:, c] >= 0) & (self.k[slot[:, c]] < score.shape[1]))
                for k in np.unique(self.k[slot[i, c]]).tolist():
                    j = i[self.k[slot[i, c]] == k]
                    inside = (score[j] >= kind(low[j, c])[:, None]) & (score[j] <= kind(high[j, c])[:, None])
                    least = np.partition(np.where(inside, score[j], none), -k, axis=1)[:, -k]
                    full = least > none
                    low[j[full], c] = np.maximum(low[j[full], c], least[full].astype(np.int64))
            hits = hit()
        i, r = np.nonzero(hits)
        s = score[i, r].astype(np.int64)
        found = []
        for c in range(slot.shape[1]):
            w = slot[i, c]
            last = np.maximum(self.k[w] - 1, 0)
            behind = (self.n[w] == self.k[w]) & (s == self.score[w, last]) & (ids[r] >= self.row[w, last])  # ties go to the smaller id
            at = np.flatnonzero((w >= 0) & (s >= low[i, c]) & (s <= high[i, c]) & ~behind)
            found.append((w[at], s[at], ids[r[at]], r[at]))
        w, s, row, r = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(w):
            return
        twin = np.zeros(len(w), bool)
        if same:
            t = np.flatnonzero(row == self.ids[self.at[w]])
            twin[t] = (rows[r[t]] == self.y[self.at[w[t]]]).all(1)
        old = np.unique(w)
        i, c = np.nonzero(np.arange(self.score.shape[1]) < self.n[old][:, None])
        w = np.concatenate([old[i], w])
        s, row, twin = np.concatenate([self.score[old[i], c], s]), np.concatenate([self.row[old[i], c], row]), np.concatenate([self.twin[old[i], c], twin])
        order = np.lexsort((row, ~s, w))  # ~s falls as s rises, for every long
        w, s, row, twin = w[order], s[order], row[order], twin[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        keep = np.flatnonzero(place < self.k[w])
        w, place = w[keep], place[keep]
        self.score[w, place], self.row[w, place], self.twin[w, place] = s[keep], row[keep], twin[keep]
        self.n[old] = np.bincount(np.searchsorted(old, w), minlength=len(old))
        full = old[self.n[old] == self.k[old]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k[full] - 1])

    def found(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.at), 8192):
            w, c = np.nonzero(np.arange(self.score.shape[1]) < self.n[start : start + 8192, None])
            w += start
            a = self.at[w]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[a], self.copies[a], self.w[w].astype(np.int32), self.row[w, c], self.score[w, c], self.twin[w, c])], _FOUND.names)


def search(anchors: DataFrame, pages: DataFrame, space: Space, dim: int) -> DataFrame:
    """(anchor_id, copy, w, vec_id, score, twin): of every share of the pages the best rows for each wish of anchors (anchor_id, copy, label, vec, wishes), both stored.

    A wish is for the k best rows of the anchor's label, or of others, with scores from low to high. twin rows are
    like the anchor in id, label and vector.
    """
    spark = anchors.sparkSession
    part = F.shiftright("page", 32).cast("int")
    counts = {r["part"]: r["n"] for r in pages.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each task that made pages
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    blocks = max(1, -(-anchors.count() // max(1, min(ANCHORS, NUMBERS // dim))))
    n, size = sum(counts.values()), pages.agg(F.max(F.length("ids"))).first()[0] or 0
    shares = min(max(n, 1), max(-(-TASKS * spark.sparkContext.defaultParallelism // blocks), -(-n * size // 8 * dim * 2 // READ)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held = None, [], None
        for batch in batches:
            cells, is_page = batch["cell"].to_numpy(), batch["ids"].is_valid().to_numpy(zero_copy_only=False)
            for a, b in _runs(cells * 2 + is_page):
                if cells[a] != cell:
                    if held:
                        yield from held.found()
                    cell, waiting, held = cells[a], [], None
                if not is_page[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    held, waiting = _Held(waiting, space, dim), []
                for r in range(a, b if held else a):
                    v = {c: batch[c][r] for c in _PAGES.names}
                    rows = np.frombuffer(v["rows"].as_buffer(), f"<i{v['bits'].as_py() // 8}").reshape(-1, dim)
                    held.see(*(v[c].values.to_numpy() for c in ("low", "high")), *(np.frombuffer(v[c].as_buffer(), "<i8") for c in ("ids", "labels")), rows)
        if held:
            yield from held.found()

    share = (F.get(F.array(*[F.lit(x).cast("long") for x in before]), part) + F.col("page").bitwiseAND(F.lit((1 << 32) - 1))) % shares
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("anchor_id", "copy", "label", "vec", "wishes", F.pmod(F.xxhash64("anchor_id", "copy"), F.lit(blocks)).alias("_block"), each(shares).alias("_share"))
    right = pages.select(*_PAGES.names, share.alias("_share"), each(blocks).alias("_block"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.col("_share").cast("int") * blocks + F.col("_block").cast("int")).drop("_share", "_block")
    rows = rows.repartitionById(shares * blocks, "cell").sortWithinPartitions("cell", F.col("ids").isNotNull(), "page")
    return rows.mapInArrow(judged, _FOUND)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _floor(a: Column) -> Column:
    """floor(a / 100) of a long."""
    return F.call_function("div", a - F.pmod(a, F.lit(100)), F.lit(100))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, page: int = PAGE, pivots: int = PIVOTS,
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels with low to high percent of the positive's score.

    Scores are inner products of the vectors' components by SCALE, rounded down. Positives are an
    anchor's best other rows of its label; ties go to the smaller vec_id. Rows take no part where the
    id, label, vector or a component is null or a component is not finite; shorter vectors count as
    filled with zeros; rows of a repeated id are rows of their own, so a repeated anchor has
    its rows twice; squared lengths beyond a long are an error; other columns are left out; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = staged(whole_numbers(rows, anchors, vec_id, vector, label), "vectors")
    n, most, dim = own.agg(F.count("*"), F.max("norm"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    dim = max(dim, 1)
    points = own.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(PIVOT_SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    space = Space(choose_pivots(_matrix(points, dim), most, pivots), most)
    size = max(page, -(-n // PAGES))
    depth = max(0, int(np.ceil(np.log2(n / size))))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(space.of_rows(_matrix(batch["vec"], dim))), pa.list_(pa.float64()))], ["d"])

    nodes = []
    if depth:
        sample = own.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "vec").limit(A_LEAF << depth).select("vec")
        seen = sample.mapInArrow(distances, "d array<double>").toArrow()["d"].combine_chunks()
        nodes = grow(np.asarray(seen.flatten()).reshape(len(seen), -1), depth)
    pages = staged(paged(own, space, dim, nodes, size), "pages")

    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "vec")).cast("long")
    named = own.filter("anchor").select(F.col("vec_id").alias("anchor_id"), copy.alias("copy"), "label", "vec")
    wish = lambda w, same, a, b, k: F.struct(w.cast("int").alias("w"), F.lit(same).alias("same"), a.cast("long").alias("low"), b.cast("long").alias("high"), F.lit(k).alias("k"))
    named = staged(named.withColumn("wishes", F.array(wish(F.lit(0), True, F.lit(LEAST), F.lit(MOST), positives + 1)).cast(_WISHES)), "anchors")
    by = Window.partitionBy("anchor_id", "copy")
    found = search(named, pages, space, dim)
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("anchor_id", "copy", "twin").orderBy(F.desc("score"), "vec_id"))).filter("not (twin and _k = 1)")  # the anchor itself
    best = found.withColumn("w", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).filter(F.col("w") <= positives)
    best = staged(best.select("anchor_id", "copy", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    asked = best.select("anchor_id", "copy", wish(F.col("w"), False, -_floor(-low * p), _floor(high * p), negatives).alias("wish")).filter("wish.low <= wish.high")
    asked = asked.groupBy("anchor_id", "copy").agg(F.collect_list("wish").cast(_WISHES).alias("wishes"))
    found = search(staged(named.drop("wishes").join(asked.hint("merge"), ["anchor_id", "copy"]), "anchors"), pages, space, dim)  # stored tables take more room in memory than their files: no broadcast
    rank = F.row_number().over(Window.partitionBy("anchor_id", "copy", "w").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    out = found.join(best.hint("merge"), ["anchor_id", "copy", "w"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
