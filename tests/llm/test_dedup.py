import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociforge.llm import suffixes
from lociforge.llm.anchors import anchors
from lociforge.llm.automata import Automaton, without_repeats
from lociforge.llm.simhash import as_hex, contracted, fingerprint, linked, near_duplicates, one_of_each
from lociforge.llm.suffixes import deduplicated, parts_of


def brute(rows, split, window):
    """doc -> (units, removed, kept) by a plain look at every window; rows in any order, ids not null."""
    least = {}
    for doc, t in rows:
        u = split(t)
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, t in rows:
        u = split(t)
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if least[tuple(u[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out[doc] = (len(u), sum(gone), [x for x, g in zip(u, gone) if not g], sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=80), st.integers(0, 40), st.integers(0, 40))
def test_shared_windows_share_an_anchor(symbols, a, b):
    window, gram = 10, 3
    one = np.array(symbols, np.uint64)
    two = np.concatenate([np.arange(a, dtype=np.uint64), one[:window], np.arange(b, dtype=np.uint64)])
    first = {int(i) for i in anchors(one, gram, window)[0] if i <= window - gram}
    second = {int(i) - a for i in anchors(two, gram, window)[0] if 0 <= i - a <= window - gram}
    assert first & second


def test_parts_cover_every_window_in_each_round():
    for window, gram in ((50, 20), (50, 25), (6, 2)):
        for parts in parts_of(window, gram):
            assert [x for a, b in parts for x in range(a, b + 1)] == list(range(window - gram + 1))
        assert all(a == b for a, b in parts_of(window, gram)[-1])


def check_bytes(df, rows, window=50, gram=20):
    expected = brute(rows, lambda t: (t or "").encode(), window)
    got = {r["doc_id"]: r for r in deduplicated(df, window, gram).collect()}
    for doc, (n, gone, kept, spans) in expected.items():
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, gone, spans), doc
        assert r["kept_sha256"] == hashlib.sha256(bytes(kept)).hexdigest()
    assert len(got) == len(expected)


def check_words(df, rows, window=50, gram=25, shard=4096):
    expected = brute(rows, lambda t: (t or "").encode().split(), window)
    got = {r["doc_id"]: r for r in without_repeats(df, window, gram, shard).collect()}
    for doc, (n, gone, kept, _) in expected.items():
        r = got[doc]
        assert (r["n_words"], r["n_removed"]) == (n, gone), doc
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert len(got) == len(expected)


def test_bytes_against_brute_force(docs, texts):
    check_bytes(docs, list(enumerate(texts)))


def test_words_against_brute_force(docs, texts):
    check_words(docs, list(enumerate(texts)))


def _crowd(spark):
    """Many texts that share a short run of words among others of their own, and longer ones in part."""
    rng = random.Random(5)
    line = "one two three four".split()
    rows = []
    for k in range(40):
        left = [rng.choice("abcdefgh") * 2 for _ in range(6)]
        right = [rng.choice("ijklmnop") * 2 for _ in range(6)] if k % 3 else "ii jj kk ll mm nn".split()
        rows.append((k, " ".join(left + line + right)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_words_of_a_hot_gram_are_refined(spark):
    df, rows = _crowd(spark)
    check_words(df, rows, window=8, gram=2, shard=3)


def test_bytes_of_a_hot_name_are_split_in_order(spark, monkeypatch):
    df, rows = _crowd(spark)
    expected = brute(rows, lambda t: t.encode(), 12)
    for most in (3, 1000):
        monkeypatch.setattr(suffixes.repeats, "__defaults__", (most,))
        got = {r["doc_id"]: r["n_removed"] for r in deduplicated(df, 12, 4).collect()}
        assert got == {k: e[1] for k, e in expected.items()}


def test_rows_are_settled_by_surroundings_and_names_by_documents(spark):
    rows = [(7, a, 1, 0, a, 0, False) for a in range(3)] + [(7, 1, 2, 0, 9, 0, False), (7, 8, 3, 0, 5, 0, False), (8, 1, 4, 0, 0, 0, False), (9, 0, 5, 0, 0, 0, True)]
    df = spark.createDataFrame(rows, "name long, around long, doc_id long, k int, at int, part int, local boolean")
    ranks = suffixes.ranked(df)
    assert {(r["doc_id"], r["at"]) for r in ranks.filter("settled").collect()} == {(2, 9), (5, 0)}
    assert {(r["doc_id"], r["at"], r["many"]) for r in suffixes.going(ranks, 4).collect()} == {(1, 0, False), (1, 1, False), (1, 2, False), (3, 5, False)}
    assert all(r["many"] for r in suffixes.going(ranks, 3).collect())


def test_most_words_go_by_matching_statistics(spark, words):
    """Copies that differ around the shared passage are found by automata, not by equal surroundings."""
    rng = random.Random(8)
    passage = [rng.choice(words) for _ in range(30)]
    rows = [(k, " ".join([rng.choice(words) for _ in range(9)] + passage + [rng.choice(words) for _ in range(9)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_words(df, rows, window=20, gram=8)


@pytest.mark.parametrize("op,n", [(deduplicated, "n_bytes"), (without_repeats, "n_words")])
def test_awkward_and_no_documents(op, n, awkward, empty, texts):
    rows = op(awkward, 6, 2).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 3), (False, 5), (False, 5), (False, 9), (False, 9), (True, 0), (True, 0)]
    whole = [r for r in rows if r["doc_id"] in (None, 5, 3)]
    assert all(r["n_removed"] == 0 for r in whole)
    copy = [r for r in rows if r["doc_id"] == 9 and r["n_removed"]]
    assert len(copy) == 1 and copy[0]["n_removed"] == copy[0][n]
    assert op(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=4), st.lists(st.integers(0, 3), max_size=16))
def test_automaton_statistics(known, query):
    a = Automaton()
    for k in known:
        a.add(k)
    seen = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
    expected = [max((n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in seen), default=0) for i in range(len(query))]
    assert list(a.statistics(query)) == expected


def plain_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius=2):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if (values[i] ^ values[j]).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_fingerprints_and_components(docs, texts):
    fps = [plain_fingerprint(t) for t in texts]
    assert [fingerprint(t) % (1 << 64) for t in texts] == fps
    got = {r["doc_id"]: (r["hex"], r["component_id"]) for r in near_duplicates(docs).withColumn("hex", as_hex(F.col("fp"))).collect()}
    assert got == {k: (f"{f:016x}", c) for (k, f), c in zip(enumerate(fps), components(fps))}


def test_links_join_all_near_points(spark):
    rng = random.Random(2)
    points = set()
    for _ in range(120):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            points.add(p)
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    values = sorted(points)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = linked(spark.createDataFrame([(v,) for v in signed], "fp long"), shard=40)
    stars = {r["a"]: r["b"] for r in contracted(links).collect()}
    label = components(values)
    roots = [stars.get(v, v) for v in signed]
    for i in range(len(values)):
        for j in range(i):
            assert (roots[i] == roots[j]) == (label[i] == label[j])


def test_contraction_of_a_long_path(spark):
    path = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a long, b long")
    assert {(r["a"], r["b"]) for r in contracted(path).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_near_duplicates_of_awkward_and_no_documents(awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == 7 and all(r["component_id"] == 5 for r in rows if r["doc_id"] == 5)
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 5").count() == 1
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0
