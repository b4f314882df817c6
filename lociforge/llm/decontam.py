"""Benchmark decontamination as a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one
window); as a set of shingles (``SHINGLE`` consecutive words) it is contained in a text only
if its rarest shingle is. So of each window one prefix token is kept: its rarest shingle,
by counts over all documents. Texts are joined on these tokens; a match must leave room for
the rest of the window on both sides (positional and length bounds), and is then verified
word by word.

The windows are broadcast in blocks of at most ``MAX_WORDS`` benchmark words: a larger
benchmark takes more passes over the documents, not more memory. Then documents are stored
once with a number for each row, and a pass writes the numbers and matches of rows that match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

SHINGLE = 3
MAX_WORDS = 1_000_000
#: Lower-cases A-Z; every byte of ASCII that is no letter or digit becomes a space.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Windows:
    """The windows of some benchmark items, as word codes, and their shingles."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.codes.setdefault(w, len(self.codes)) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners[tuple(ids[i : i + size])].add(item)
        self.owners = [(w, sorted(x)) for w, x in sorted(owners.items())]
        self.base = len(self.codes) + 1
        self.widths = sorted({min(SHINGLE, len(w)) for w, _ in self.owners})

    def shingles(self, ids: np.ndarray, width: int) -> np.ndarray:
        """A number for each run of ``width`` words; -1 where a word is not of the benchmark."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            out = out * self.base + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        return np.where(known, out * 4 + width, -1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def all_shingles(self) -> np.ndarray:
        parts = [self.shingles(np.array(w), min(SHINGLE, len(w))) for w, _ in self.owners]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)

    def keyed(self, counts: dict[int, int]) -> dict[int, list[tuple[int, np.ndarray, list[str]]]]:
        """Windows by their rarest shingle, with its place in the window."""
        out = defaultdict(list)
        for w, items in self.owners:
            own = self.shingles(np.array(w), min(SHINGLE, len(w))).tolist()
            at = min(range(len(own)), key=lambda i: (counts.get(own[i], 0), own[i], i))
            out[own[at]].append((at, np.array(w), items))
        return dict(out)


def _counts(docs: DataFrame, text: str, shared) -> dict[int, int]:
    """How often each shingle of the benchmark occurs in all documents."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows: Windows = shared.value
        wanted = windows.all_shingles()
        total = np.zeros(len(wanted), np.int64)
        for part in parts:
            for x in part[text]:
                ids = windows.ids(words_of(x))
                for width in windows.widths:
                    s = windows.shingles(ids, width)
                    s = s[s >= 0]
                    at = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
                    np.add.at(total, at[wanted[at] == s], 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"shingle": wanted[seen], "n": total[seen]})

    rows = docs.select(text).mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"]: r["n"] for r in rows.toLocalIterator()}  # a row for each shingle of the block at most


def _finder(shared):
    @F.pandas_udf(_FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows, keyed = shared.value
        keys = np.array(sorted(keyed), np.int64)

        def one(text):
            words = words_of(text)
            ids = windows.ids(words)
            runs, items = [], set()
            for width in windows.widths:
                s = windows.shingles(ids, width)
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                for p in np.flatnonzero(keys[at] == s).tolist():
                    for place, window, owners in keyed[int(s[p])]:
                        b, e = p - place, p - place + len(window)
                        if b >= 0 and e <= len(ids) and (ids[b:e] == window).all():
                            runs.append((b, e))
                            items.update(owners)
            return len(words), [b for b, _ in runs], [e for _, e in runs], sorted(items)

        for part in texts:
            yield pd.DataFrame([one(x) for x in part], columns=_FOUND.names)

    return find


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).dropna()


def _n_blocks(benchmark: DataFrame, item: str, text: str, max_words: int) -> int:
    size = _items(benchmark, item, text).agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    return int(size // max_words) + 1


def _blocks(benchmark: DataFrame, item: str, text: str, n: int) -> Iterator[list[tuple[str, str]]]:
    """The items in n blocks, each small enough to broadcast and collected when it is needed."""
    block = F.pmod(F.xxhash64("item"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in _items(benchmark, item, text).filter(block == k).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """docs with the column hits: n_words, starts and ends of the matches, and the items that match.

    Null and empty texts have no words and no hits; items with a null id or text, or without
    a word, have no windows; items of equal text all match; an empty benchmark matches
    nothing; a column of docs named hits is replaced.
    """
    spark = docs.sparkSession
    other = [c for c in docs.columns if c not in (text, "hits")]
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in other] or [F.lit(True).alias("none")]).alias("row"))

    def found_in(source: DataFrame, items: list[tuple[str, str]]) -> tuple[DataFrame, Broadcast]:
        windows = Windows(items, size)
        shared = spark.sparkContext.broadcast(windows)
        keyed = windows.keyed(_counts(source, "text", shared) if windows.owners else {})
        shared.destroy()
        found = spark.sparkContext.broadcast((windows, keyed))
        find = _finder(found)
        return source.withColumn("hits", (find if n == 1 else find.asNondeterministic())(F.col("text"))), found  # not again for a filter

    n = _n_blocks(benchmark, item, item_text, max_words)
    blocks = _blocks(benchmark, item, item_text, n)
    if n == 1:
        rows, _ = found_in(rows, next(blocks))
    else:
        rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "decontam")
        found = None
        for items in blocks:
            own, shared = found_in(rows.select("id", "text"), items)
            own = staged(own.select("id", "hits").filter(F.size("hits.starts") > 0), "hits")
            shared.destroy()
            found = own if found is None else found.union(own)
        all_ = lambda f: F.flatten(F.collect_list(f"hits.{f}"))
        found = found.groupBy("id").agg(all_("starts").alias("starts"), all_("ends").alias("ends"), F.array_distinct(all_("items")).alias("items"))
        none = F.array().cast("array<int>")
        hits = F.struct(_n_words(F.col("text")).alias("n_words"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        rows = rows.join(found, "id", "left").select("text", "row", hits.alias("hits"))
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "hits"], "hits")


@F.pandas_udf(T.LongType())
def _n_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(x)) for x in texts], dtype="int64")


@F.pandas_udf(T.LongType())
def covered(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Words in the union of the runs."""

    def one(b, e) -> int:
        total, upto = 0, 0
        for x, y in sorted(zip(b, e, strict=True)):
            total += max(0, y - max(x, upto))
            upto = max(upto, y)
        return int(total)

    return pd.Series([one(b, e) for b, e in zip(starts, ends, strict=True)], dtype="int64")


def contamination_table(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: its words, those inside a window's occurrence, and the items found."""
    rows = contaminated(docs.select("doc_id", "text"), benchmark, size)
    n_hit = F.when(F.size("hits.starts") > 0, covered("hits.starts", "hits.ends")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc_id", "hits.n_words", n_hit.alias("n_hit"), F.array_sort("hits.items").alias("items"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


