"""Exact passage dedup with suffix automata of reference shards.

A word is removed if a window of ``window`` words that covers it also starts in a document
with a smaller doc_id. Copies of a whole text are settled by their hash. Elsewhere a window
can only repeat around an anchor gram that several documents have (see anchors.py), so the
reference is the passages around those, in shards by gram. Every document is a reference
for later ones, so the reference grows with the corpus and can't be broadcast whole: instead
the passages of a document go to the shards of their grams. There, in ascending doc_id
order, a passage is streamed through the suffix automaton of the passages before it; the
matching statistics give its maximal spans of ``window`` words or more; then it is added.
Equal passages of a shard are streamed once: a later copy matches the earlier one whole.

A shard is bounded by ``SHARD`` distinct passages. A gram that has more is made longer, in
parts, as suffixes are in suffixes.py, until its shards are small enough; grams as long as a
window have one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.anchors import shared_grams
from lociforge.llm.shared import staged
from lociforge.llm.suffixes import (
    SAME_K, Words, bucketed_texts, buckets_of, children_of, firsts, going, named, names_of, parts_of, passages, ranked, results, settled_of, slim,
)

WINDOW, GRAM, SHARD = 50, 25, 4096


class Automaton:
    """The suffix automaton of some sequences of words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, following: dict, link: int, size: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state of q's strings up to one word more than p's."""
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, self.next[last][word], word)
                continue
            new, p = self._state({}, 0, self.size[last] + 1), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def statistics(self, words: list) -> Iterator[int]:
        """For each word the length of the longest known sequence that ends there."""
        at = length = 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.size[at]
            if word in self.next[at]:
                at = self.next[at][word]
                length += 1
            yield length

    def knows(self, words: list) -> bool:
        """Whether words stand in one of the sequences."""
        at = 0
        for word in words:
            at = self.next[at].get(word)
            if at is None:
                return False
        return True

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans of words in matches of at least ``least`` words."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.statistics(words)):
            if n >= least:
                a = i - n + 1
                if out and a <= out[-1][1]:
                    a = min(a, out.pop()[0])
                out.append((a, i + 1))
        return out


def matched(passages: list[tuple[object, int, list]], least: int) -> list[tuple[object, int, int]]:
    """(key, begin, end) of what each of the passages (key, doc_id, words) repeats of those of smaller documents."""
    known, out, waiting, doc = Automaton(), [], [], None
    for key, own, words in passages:  # ascending doc_id
        if own != doc:
            for w in waiting:
                known.add(w)
            waiting, doc = [], own
        spans = known.spans(words, least)
        out += [(key, a, b) for a, b in spans]
        if spans != [(0, len(words))] or not known.knows(words):
            waiting.append(words)
    return out


def _streamed(own: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, k, begin, end) of passages in order of (name, doc_id)."""
    columns = ["name", "doc_id", "k", "begin", "passage"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in names_of(x.select(columns) for x in batches):
            name, out = b["name"].to_numpy(), []
            cuts = [*np.flatnonzero(np.append(True, name[1:] != name[:-1])).tolist(), len(name)]
            doc, words = b["doc_id"].to_pylist(), [x.split() for x in b["passage"].to_pylist()]
            for i, j in zip(cuts, cuts[1:], strict=False):
                out += matched([(p, doc[p], words[p]) for p in range(i, j)], window)
            row = np.array([x[0] for x in out], np.int64)
            begin = b["begin"].to_numpy()[row]
            ends = [pa.array(begin + np.array([x[i] for x in out], np.int64), pa.int32()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), b["k"].take(pa.array(row)), *ends], ["doc_id", "k", "begin", "end"])

    return own.mapInArrow(scan, "doc_id long, k int, begin int, end int")


def repeated_passages(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, k, begin, end): spans of words that smaller documents have, of ``window`` words or more."""
    n = buckets_of(texts.sparkSession)
    rounds = parts_of(window, gram)
    todo = shared_grams(texts, Words, gram, window, n)
    found = None
    for r, parts in enumerate(rounds):
        ranks = staged(ranked(named(texts, todo, parts, gram, window, Words)), f"passages{r}")
        copies = settled_of(ranks, parts)
        begin = F.greatest(F.col("at") - F.col("greatest"), F.lit(0))
        copies = copies.select("doc_id", "k", begin.alias("begin"), (F.col("at") - F.col("least") + window).alias("end"))
        found = copies if found is None else found.unionByName(copies)
        if r + 1 == len(rounds):
            break  # a passage of these is a window, and a name has one
        left = staged(going(ranks, shard), f"left{r}")
        own = passages(texts, left.filter("not many"), parts, window, Words).repartition(n, "name").sortWithinPartitions("name", "doc_id")
        found = found.unionByName(staged(_streamed(own, window), f"spans{r}"))
        todo = left.filter("many").select("doc_id", "k", "at", F.explode(children_of(rounds, r)).alias("child"))
        if todo.isEmpty():
            break
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text).

    kept: the remaining words joined by one space; null where all or none are left. Null
    texts have no words; texts under ``window`` words stay whole; a null doc_id is smaller
    or greater than none; of equal texts the one with the smallest doc_id counts, and rows
    that share a doc_id never remove each other's words. An empty table gives an empty result.
    """
    one = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    rows = slim(docs, lambda x: F.when(F.length(x) == 0, 0).otherwise(F.size(F.split(x, " "))), one)
    first = staged(firsts(rows, window), "firsts")
    texts = bucketed_texts(docs, first)
    found = repeated_passages(texts, window, gram, shard)
    spans = found.groupBy("doc_id", F.col("k").alias("_k")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                view = Words(text.as_buffer().to_pybytes())
                edge = np.zeros(view.n + 1, np.int64)
                for s in own:
                    e = min(view.n, s["end"])
                    if e - s["begin"] >= window:
                        edge[s["begin"]] += 1
                        edge[e] -= 1
                mask = np.cumsum(edge[: view.n]) > 0
                kept = b" ".join(w for w, gone in zip(view.words, mask.tolist(), strict=True) if not gone)
                runs = int(mask[0]) + int((np.diff(mask.astype(np.int8)) == 1).sum())
                out.append((int(mask.sum()), runs, hashlib.sha256(kept).digest(), kept))
            cols = [batch["k1"], batch["k2"], batch["doc_id"]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            cols += [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "first", "n_removed", "n_spans", "kept_sha", "kept"])

    changed = texts.join(spans, "doc_id").filter(SAME_K).select("k1", "k2", "doc_id", "text", "spans")
    changed = changed.mapInArrow(cut, "k1 long, k2 long, first long, n_removed long, n_spans long, kept_sha binary, kept binary")
    return results(rows, first, changed).withColumnRenamed("n", "n_words")
