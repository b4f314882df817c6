import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from lociforge.llm import divergence as d

ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "text")])
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(rows, min_docs=3, top=200):
    by, docs, langs = {}, {}, {}
    for lang, source, text in rows:
        lang, words = lang or "", _terms(text)
        by.setdefault((lang, source or ""), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
        langs.setdefault(lang, Counter()).update(words)
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    gap = lambda p, q: (p - q) ** 2 // q
    rank = lambda items: [(k + 1, *x) for k, x in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())))]
    for (lang, source), own in by.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        p = lambda c: {t: share(c[t], sum(c[x] for x in kept), len(kept)) for t in kept}
        mine, whole = p(own), p(langs[lang])
        others = [(s, sum(gap(mine[t], q) for t, q in p(c).items())) for (x, s), c in by.items() if x == lang and s != source]
        terms = [(t, gap(mine[t], whole[t])) for t in kept if own[t] and mine[t] > whole[t]]
        out += [(lang, source, "pair", item, value, k) for k, item, value in rank(others)]
        out += [(lang, source, "term", item, value, k) for k, item, value in rank(terms)[:top]]
    return sorted(out)


def _rows(spark, rows, **limits):
    return sorted(map(tuple, d.divergences(spark.createDataFrame(rows, ROW), **limits).collect()))


def test_as_a_dense_sum(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "δ", "x\u0085y", "Z", "rare", *("w" + "abcdefgh"[k % 8] * (k // 8 + 1) for k in range(60))]
    rows = []
    for _ in range(160):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "B", "é", "", None])
        rows.append((lang, source, " ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 40)))))
    rows += [("en", "a", None), ("en", "empty", ""), ("en", "empty", "1 2 _"), ("xx", "a", "once only"), ("xx", "b", None), ("en", "a", "Alpha, beta3GAMMA! " * 400)] + rows[:5]
    for k in (d.PRICED, 7):  # a posting list is cut anywhere
        monkeypatch.setattr(d, "PRICED", k)
        assert _rows(spark, rows, top=6) == _brute(rows, top=6)


def test_edges(spark):
    assert _rows(spark, []) == []
    assert _rows(spark, [(None, None, None)]) == []
    assert _rows(spark, [("l", "a", "x"), ("l", "b", None)]) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]
    clash = spark.createDataFrame([("l", "a", "x y", 1, 2)] * 3, T.StructType([*ROW, T.StructField("n", T.LongType()), T.StructField("term", T.LongType())]))
    assert sorted(map(tuple, d.divergences(clash).collect())) == _brute([("l", "a", "x y")] * 3)


def test_long_texts_come_in_runs(monkeypatch):
    monkeypatch.setattr(d, "CHUNK", 10)
    text = "One two-THREE été\n" * 9
    assert [w.decode() for run in d.terms_of(text.encode()) for w in run] == _terms(text)


def test_sums_of_large_gaps_are_exact():
    rng = np.random.default_rng(1)
    n = 3000
    term, g = np.repeat(np.arange(n // 3), 3), np.tile(np.arange(3), n // 3)
    p, zero = rng.integers(1, 10**9, n), np.tile([1, 17, 10**6], n // 3)
    want = Counter()
    for t in range(n // 3):
        for a in range(3):
            for b in range(3):
                if a != b:
                    i, j = 3 * t + a, 3 * t + b
                    f = lambda x, y: (int(x) - int(y)) ** 2 // int(y)
                    want[a, b] += f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
    got = Counter()
    for a, b, high, low in d.priced(term, g, p, zero):
        for x, y, h, k in zip(a.tolist(), b.tolist(), high.tolist(), low.tolist(), strict=True):
            got[x, y] += (h << 31) + k
    assert got == want
