"""SimHash near-duplicates, found with vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree whose points come from a
sample, some for each shard: at each node the fingerprints at distance mu + radius or less from the
vantage point go inside, those farther than mu go outside. By the triangle inequality two
fingerprints within the radius are together on at least one side, so those near the boundary
go to both shards, and every pair meets somewhere. Within a shard the same splitting goes on
down to small blocks, where all pairs are compared. A block reports each fingerprint's link
to the smallest of its component only, so that links grow with the fingerprints, not with
their square. Components across blocks are found by star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

RADIUS, SHINGLE = 2, 3
#: Fingerprints of a sample for each shard, from which the top of the tree is built, and of all of it at most.
A_SHARD, SAMPLE = 64, 1_000_000
SHARD, BLOCK = 16_000, 256
_SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, as a signed number of 64 bits; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *ends[: n - 1]], ends[-n:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a : b - 1], _SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    count = sum(np.unpackbits(h[i : i + _CHUNK, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, _CHUNK))
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(x, shingle) for x in part], dtype="int64")

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few points the one whose distances spread most, and their median."""
    tried = points[:: max(1, len(points) // 8)][:8]
    seen = points[:: max(1, len(points) // 1000)]
    spread = [np.var(_distance(seen, p)) for p in tried]
    best = tried[int(np.argmax(spread))]
    return best, int(np.median(_distance(points, best)))


def grow(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """A complete vantage-point tree in heap order: (point, mu) of each inner node."""
    nodes, level = [], [sample]
    for _ in range(depth):
        below = []
        for points in level:
            if len(points):
                p, mu = _vantage(points)
            else:
                p, mu = np.uint64(0), 32
            nodes.append((int(p), mu))
            d = _distance(points, p)
            below += [points[d <= mu], points[d > mu]]
        level = below
    return nodes


def shards_of(points: np.ndarray, nodes: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, place of the point) for each shard that a point belongs to."""
    out, todo = [], [(0, np.arange(len(points)))]
    while todo:
        k, at = todo.pop()
        if not len(at):
            continue
        if k >= len(nodes):
            out.append((k - len(nodes), at))
            continue
        p, mu = nodes[k]
        d = _distance(points[at], np.uint64(p))
        todo += [(2 * k + 1, at[d <= mu + radius]), (2 * k + 2, at[d > mu])]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([np.full(len(a), s, np.int64) for s, a in out]), np.concatenate([a for _, a in out])


def _stars(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, smallest of its component) of a block in which all pairs are compared."""
    label = np.arange(len(points))
    while True:
        new = label.copy()
        for i in range(0, len(points), 1024):
            near = np.bitwise_count(points[i : i + 1024, None] ^ points[None, :]) <= radius
            new[i : i + 1024] = np.where(near, label[None, :], len(points)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(points)))
    return points[away], points[label[away]]


def links_within(points: np.ndarray, radius: int, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star links of all blocks of one shard; points are distinct and sorted."""
    out, todo = [], [points]
    while todo:
        own = todo.pop()
        if len(own) > block:
            p, mu = _vantage(own)
            d = _distance(own, p)
            near, far = own[d <= mu + radius], own[d > mu]
            if max(len(near), len(far)) < 0.95 * len(own):
                todo += [near, far]
                continue
        if len(own) > 1:
            out.append(_stars(own, radius))
    return out


def linked(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b), b < a, of distinct fingerprints ``fp``: their closure joins all within radius."""
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    points = np.empty(0, np.uint64)
    if depth:
        sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, A_SHARD << depth))
        points = sample.select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    depth = min(depth, max(0, int(np.log2(max(len(points), 1) / 16))))
    nodes = grow(np.sort(points), depth)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part["fp"].to_numpy(np.int64)
            k, at = shards_of(own.view(np.uint64), nodes, radius)
            yield pd.DataFrame({"shard": k, "fp": own[at]})

    def search(part: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(part["fp"].to_numpy(np.int64).view(np.uint64))
        found = links_within(own, radius)
        a = np.concatenate([x for x, _ in found]) if found else own[:0]
        b = np.concatenate([x for _, x in found]) if found else own[:0]
        a, b = a.view(np.int64), b.view(np.int64)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    dealt = fps.select("fp").mapInPandas(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def contracted(links: DataFrame, name: str = "stars") -> DataFrame:
    """(a, b): every node of the graph but the smallest of each component, and that smallest one.

    Alternates large stars and small stars until nothing changes; each round's links are
    written to the shared folder, and the rounds grow with the logarithm of the longest path.
    """
    links = staged(links, name)
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).select("col.a", "col.b")
        links = staged(small.filter("a > b").distinct(), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links
        seen = now


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of ``fps`` (doc_id, fp).

    component_id is the smallest doc_id that links reach; root names the component.
    """
    own = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    stars = contracted(linked(own.select("fp"), radius))
    rooted = own.join(stars.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of docs.

    Null and empty texts have the fingerprint 0 and link like any other. Rows of a repeated
    doc_id each have a row; null ids count in no minimum, and a component without ids has a
    null component_id. An empty table gives an empty result.
    """
    rows = staged(docs.select("doc_id", fingerprints(F.col(text), shingle).alias("fp")), "simhash")
    return rows.join(grouped(rows, radius).drop("root"), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays."""
    slim = staged(docs.select("doc_id", fingerprints(F.col(text), shingle).alias("fp")), "simhash")
    groups = staged(grouped(slim, radius), "groups").withColumnRenamed("fp", "_fp").withColumnRenamed("component_id", "_component")
    firsts = slim.join(groups, F.col("fp") == F.col("_fp")).filter(F.col("doc_id").eqNullSafe(F.col("_component"))).select("root")
    repeated = firsts.count() > firsts.distinct().count()
    rows = docs.withColumn("_fp", fingerprints(F.col(text), shingle)).join(groups, "_fp")
    rows = rows.filter(F.col("doc_id").eqNullSafe(F.col("_component")))
    if repeated:  # rows that share a doc_id
        rows = rows.dropDuplicates(["root"])
    return rows.select(*docs.columns)
