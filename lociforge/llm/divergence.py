"""How far the sources of a language are from each other in their words: exact sums over a shared vocabulary.

Sums over all terms of a language would be dense for every pair of sources. Here they are
taken by inclusion and exclusion over the supports: a pair's sum is what each source's own
terms give against the constant that a term of count 0 has in the other (from histograms
of counts, which are small), plus what the terms that neither has give (a constant times
their number), corrected on the terms that both have (from sparse postings).
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

#: Documents of a language that hold a term of its vocabulary, pseudo-count of a term, whole of the shares, terms told of a group.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms that a task counts before it passes them on, and bytes of text in hand.
HELD, CHUNK = 400_000, 4 << 20
#: Pairs of postings that are priced at once.
PRICED = 1 << 20

_SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))
_COUNTED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("docs", T.LongType()),
])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs: letters of ASCII in lower case and all that is beyond ASCII."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, and a row without term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in counts.items():
            k = len(n)
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            cols = [pa.array([lang] * (k + 1), pa.string()), pa.array([source] * (k + 1), pa.string()), terms]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], _COUNTED.names)

    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
            n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
            seen = set()
            for words in terms_of(text.as_py() or b""):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from rows()
            counts.clear()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; each group has a row without term.

    Nulls of text, lang and source count as empty. Tasks count their own documents, so a term
    is shuffled once for a task and group however often it occurs; groups meet by (lang, term).
    """
    rows = docs.select("lang", "source", "text").mapInArrow(_counted, _COUNTED).repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); null where there are no terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return 1 + _div(above, F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q) of whole numbers up to about SCALE."""
    return _div((p - q) * (p - q), q)


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of counts whose term min_docs documents of their language have, and those without term.

    all_n has the occurrences of the term in the language; lead marks one row of each term of a language.
    """
    w = Window.partitionBy("lang", "term")
    rows = counts.withColumns({"_docs": F.sum("docs").over(w), "all_n": F.sum("n").over(w), "_first": F.min("source").over(w)})
    rows = rows.filter(F.col("term").isNull() | (F.col("_docs") >= min_docs))
    lead = F.col("term").isNotNull() & (F.col("source") == F.col("_first"))
    return rows.select("lang", "source", "term", "n", "all_n", lead.alias("lead"))


def groups_of(kept: DataFrame) -> DataFrame:
    """(lang, source, g, total, support, terms, all_total, zero) of each group of a vocabulary.

    total and all_total are occurrences in the group and its language, support and terms the
    terms that either has, zero the share of a term that the group lacks; g numbers a language's groups.
    """
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum("n").alias("all_total"))
    rows = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g")
    rows = rows.select("*", number).join(langs, "lang")
    return rows.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))


_OVERLAPS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    T.StructField("high", T.LongType()), T.StructField("low", T.LongType()),
])


def priced(term: np.ndarray, g: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, high, low): for pairs of groups the sum of what their common terms add to the one-sided sums, as high * 2 ** 31 + low.

    Postings (codes of terms, groups, shares, shares of count 0) of one language, sorted by term. Pairs are made
    and summed PRICED at a time; sums of so many parts of 31 bits are exact as doubles.
    """
    n = len(term)
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    upto = np.cumsum(size)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRICED, "right")))
        m = size[at:end]
        i = np.repeat(np.arange(at, end), m)
        j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:end], m)
        i, j = i[i != j], j[i != j]
        pa_, pb, za, zb = p[i], p[j], zero[i], zero[j]
        f = lambda x, y: (x - y) ** 2 // y
        value = f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)
        width = int(g.max()) + 1
        keys, k = np.unique(g[i].astype(np.int64) * width + g[j], return_inverse=True)
        high = np.bincount(k, value >> 31, len(keys)).astype(np.int64)
        low = np.bincount(k, value & ((1 << 31) - 1), len(keys)).astype(np.int64)
        yield keys // width, keys % width, high, low
        at = end


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of priced() for the postings of a task, which come sorted by language and term."""
    held = None

    def done(part: pd.DataFrame):
        for lang, own in part.groupby("lang", sort=False):
            codes = pd.factorize(own["term"])[0]
            for a, b, high, low in priced(codes, *(own[c].to_numpy(np.int64) for c in ("g", "p", "zero"))):
                cols = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(high), pa.array(low)]
                yield pa.RecordBatch.from_arrays(cols, _OVERLAPS.names)

    for batch in batches:
        part = batch.to_pandas()
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        if len(part):
            last = (part["lang"] == part["lang"].iloc[-1]) & (part["term"] == part["term"].iloc[-1])  # its other postings may follow
            yield from done(part[~last])
            held = part[last]
    if held is not None:
        yield from done(held)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of each two groups of a language: the sum of gap(share in source, share in other) over all terms."""
    wide = lambda x: x.cast("decimal(38,0)")
    terms = kept.filter("term is not null").select("lang", "source", "term", "n").join(groups, ["lang", "source"])
    terms = terms.select("lang", "g", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "zero")
    side = lambda x: groups.select("lang", *[F.col(c).alias(f"{x}_{c}") for c in ("g", "source", "zero", "support")])
    pairs = side("a").join(side("b"), "lang").filter("a_g <> b_g")  # the rows of the result
    pairs = pairs.join(groups.select("lang", "terms").distinct(), "lang")
    neither = F.col("terms") - F.col("a_support") - F.col("b_support")
    parts = pairs.select("lang", F.col("a_g").alias("a"), F.col("b_g").alias("b"), (wide(neither) * gap(F.col("a_zero"), F.col("b_zero"))).alias("value"))
    shares = terms.groupBy("lang", "g", "p").agg(F.count("*").alias("k"))  # one for each count that a group has
    zeros = groups.select("lang", F.col("g").alias("_g"), "zero")
    sided = shares.join(zeros, "lang").filter("g <> _g")
    parts = parts.union(sided.select("lang", "g", "_g", wide(F.col("k")) * gap(F.col("p"), F.col("zero"))))
    parts = parts.union(sided.select("lang", "_g", "g", wide(F.col("k")) * gap(F.col("zero"), F.col("p"))))
    common = terms.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_overlaps, _OVERLAPS)
    parts = parts.union(common.select("lang", "a", "b", wide(F.col("high")) * (1 << 31) + F.col("low")))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = pairs.select("lang", F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.col("a_source").alias("source"), F.col("b_source").alias("other"))
    return names.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "other", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank): of each group the terms that it has more of than its language, by gap, then term."""
    rows = kept.filter("term is not null").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    rows = rows.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", "term", gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has every other source of the language, part term the group's top terms.

    Nulls of text, lang and source count as empty; a group of empty texts is compared like any other (all its
    terms have count 0); a language without vocabulary has pairs of value 0 and no terms;
    repeated rows count each; other columns are left out; an empty table gives an empty result.
    """
    kept = staged(vocabulary(term_counts(docs), min_docs), "postings")
    groups = staged(groups_of(kept), "groups")
    pairs = pair_sums(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))
    terms = top_terms(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.union(terms)
