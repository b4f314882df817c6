import hashlib
import os
import re
import subprocess
import sys
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociforge.llm import quality
from lociforge.llm.decontam import _blocks, _n_blocks, contaminated, contamination_table
from lociforge.llm.html import host_of, main_text, parse
from lociforge.llm.pii import KINDS, PLAIN, masked, pii_table, with_spans
from lociforge.llm.quality import fit, judged, measure, quality_table
from lociforge.llm.sentencepiece import Codec, Model, codec, encoded, runs_of


def plain_measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


QUALITY = ["a b c a b c", "x\nx\n x\n\n\nx", "#1 *$ <b> & | 100%", "é" * 40 + " " + "ß ü " * 30, "one " * 200, None, "", "\x1fa\x85b　c"]


@pytest.mark.parametrize("text", QUALITY)
def test_measures(text):
    got = measure(text)
    assert (got[0], got[1], got[2], got[4], got[5]) == plain_measure(text)


def test_estimates_tell_good_from_bad():
    patterns = [((1, 1, 1), 900), ((0, 1, 1), 40), ((1, 0, 1), 30), ((1, 1, 0), 25), ((-1, -1, -1), 5), ((0, 0, 1), 3)]
    prior, right = fit(patterns)  # nothing but single rules opposes them, so the rules are wrong
    assert prior > 0.95 and (right[1] > 0.9).all() and (right[1] < 0.98).all()
    prior, told = fit(patterns, [((0, 1, 1), 0, 60), ((1, 1, 1), 1, 600), ((1, 0, 1), 1, 20)])  # labels say that the first is right
    assert prior < 0.95 and told[1, 0] > 0.99 and told[1, 1] < 0.98
    assert fit([]) == (0.5, pytest.approx(np.zeros((2, 0))))


def test_judgement_keeps_clean_documents(spark, words):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(words, 120)) for _ in range(60)]
    junk = [" ".join(f"{w}###" for w in rng.choice(words, 80)) for _ in range(6)] + [" | ".join(rng.choice(words, 80)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate([*clean, *junk, "short text", None])]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in [*range(12), 60, 61, 62, 66, 67]] + [(5, None), (6, 0), (99, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string"), labels=labels).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 73))
    assert got[71]["base_failed"] and got[72]["base_failed"]


def test_the_estimate_is_that_of_a_plain_expectation_maximisation():
    """Document by document and rule by rule, with the prior and the labelled documents as so many more votes."""
    rng = np.random.default_rng(5)
    good = rng.random(300) < 0.85
    votes = np.where(rng.random((300, 4)) < 0.3, -1, np.where(rng.random((300, 4)) < np.where(good, 0.97, 0.3)[:, None], 1, 0))
    patterns = {}
    for v in map(tuple, votes.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
    labelled = [((1, 0, 1, -1), 0, 9), ((1, 1, 1, 1), 1, 40), ((0, 1, -1, 1), 1, 3)]
    for known in ([], labelled):
        _as_a_plain_one(patterns, votes, known)


def _as_a_plain_one(patterns, votes, labelled):
    prior, right = fit(sorted(patterns.items()), labelled)
    worth, n_known, n_good = quality.PRIOR["documents"], sum(k for _, _, k in labelled), sum(k for _, label, k in labelled if label)
    own = lambda rule, kind, sure: sum(k for v, label, k in labelled if label == kind and (v[rule] == kind if sure else v[rule] >= 0))
    p = [0.1 if 0 in v else 0.95 for v in votes.tolist()]
    if labelled:
        p = None
    for _ in range(500):
        acc = []
        for rule in range(4):
            both = []
            for kind, mean in ((0, quality.PRIOR["bad"]), (1, quality.PRIOR["good"])):
                weight = [x if kind else 1 - x for x in p] if p else [0] * 300
                cast = sum(w for w, v in zip(weight, votes) if v[rule] >= 0) + own(rule, kind, False)
                hit = sum(w for w, v in zip(weight, votes) if v[rule] == kind) + own(rule, kind, True)
                both.append((hit + worth * mean) / (cast + worth))
            acc.append(both)
        share = ((sum(p) if p else 0) + n_good + worth * quality.PRIOR["share"]) / ((300 if p else 0) + n_known + worth)
        new = []
        for v in votes.tolist():
            yes, no = share, 1 - share
            for rule, (bad, ok) in enumerate(acc):
                if v[rule] >= 0:
                    yes *= ok if v[rule] else 1 - ok
                    no *= 1 - bad if v[rule] else bad
            new.append(yes / (yes + no))
        done = p is not None and max(abs(a - b) for a, b in zip(p, new)) < 1e-9
        p = new
        if done:
            break
    assert prior == pytest.approx(share, abs=1e-6) and right == pytest.approx(np.array(acc).T, abs=1e-6)


def test_the_posterior_outvotes_a_rule_that_opposes_clean_documents(spark, words):
    rng = np.random.default_rng(1)
    loud = lambda w: [x.upper() if rng.random() < 0.7 else x for x in w]
    texts = [" ".join(loud(rng.choice(words, 120)) if i % 10 < 3 else rng.choice(words, 120)) for i in range(200)]
    junk = [" ".join(f"{w}#!" for w in rng.choice(words, 80)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate([*texts, *junk])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in [*range(30), *range(200, 205)]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in judged(rows, labels=labels).collect()}
    assert sum(100 * got[i]["measures"]["n_upper"] > 40 * got[i]["measures"]["n_words"] for i in range(200)) > 50
    assert all(got[i]["kept"] for i in range(200)) and not any(got[i]["kept"] for i in range(200, 220))
    assert max(got[i]["quality"] for i in range(200)) < 1


def test_held_out_labels_are_met_better_than_by_all_rules_together(spark, monkeypatch):
    """Half of the labels are in the estimate; on the others the posterior is right more often than all-must-pass."""
    path = "/root/testdata/sf0.01"
    if not os.path.exists(f"{path}/labels.parquet"):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    known, held = (labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k) for k in (0, 1))
    rows = judged(docs, labels=known).withColumn("all", ~F.col("base_failed") & ~F.exists(F.array(*quality.rules().values()), lambda v: v == 0))
    told = rows.filter("not base_failed").join(held.select("doc_id", F.col("quality").alias("label")), "doc_id").select("label", "kept", "all").collect()
    right = lambda c: sum(r[c] == (r["label"] == 1) for r in told) / len(told)
    assert len(told) > 100 and right("kept") > 0.99 > 0.9 > right("all")
    sample = quality.labelled_votes(quality.measured(docs), labels, most=50)
    assert sum(k for _, _, k in sample) == 50 and {label for _, label, _ in sample} == {0, 1}


def test_data_overrule_the_prior():
    """A rule that opposes half of the documents that all others like is worth nothing after some thousands."""
    few, many = ([((1, 1, 1, 1), k), ((0, 1, 1, 1), k), ((0, 0, 0, 0), k // 5)] for k in (5, 5000))
    assert fit(few)[1][1, 0] > fit(many)[1][1, 0] and fit(many)[1][1, 0] < 0.6


def test_variety_does_not_fall_with_length(spark, words):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, 120)) for _ in range(60)] + [" ".join(rng.choice(words, 9000)), "one two three four five " * 40]
    got = {r["doc_id"]: r["kept"] for r in judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[60] and not got[61]


def test_quality_of_awkward_and_no_documents(awkward, empty):
    assert quality_table(awkward).count() == 7
    assert judged(awkward).count() == 7 and judged(empty).count() == 0 and quality_table(empty).count() == 0


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        return kind == "email" or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15

    found = [(m.start(), list(PLAIN).index(k), m.end(), k) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if ok(k, m[0])]
    return sorted(found)


PII = [
    "write to a.b+c@x-y.example.com, or x@a.b_c@d.e.f and @no.where", "é😀 at 10.0.0.256, 10.0.0.255; 1.2.3.4.5.6.7.8 0010.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559", "call +1 (487) 555-7209 or +12 34, +1234567890123456", "1 " * 3000,
    "a" * 5000 + "@" + "b." * 3000 + "c", "7" * 20000, "+" * 500 + "1" * 12, None, "", "x@y", "+1 23456789 \n+1 234567890", "1.1.1.1@2.2.2.2",
    " ".join(f"u{i}@h.org" for i in range(700)),
]


def test_spans_against_python(spark):
    rows = pii_table(spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")).collect()
    for r in rows:
        spans = plain_spans(PII[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), r["doc_id"]
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(s[3] == kind for s in spans)


def test_a_text_of_many_matches(spark):
    """Places by running sums: time grows with the matches."""
    n, card = 120_000, "4111 1111 1111 1111"
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{card} x "), F.repeat(F.lit("12 ,"), n), F.lit(card), F.repeat(F.lit("x3,"), n), F.lit(f"+{card}")).alias("text"))
    began, at = time.perf_counter(), 4 * n + 22
    (r,) = pii_table(df).collect()
    assert r["spans"] == f"card:0:19,card:{at}:{at + 19},card:{at + 20 + 3 * n}:{at + 39 + 3 * n}" and time.perf_counter() - began < 90


def test_validators_and_context_of_added_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 end", "IBAN GB82 WEST 1234 5698 7654 33 end", "ssn: 123-45-6789", "part 123-45-6789", "DE89370400440532013000"]
    rows = with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["pii"] if s["kind"] not in PLAIN] for r in rows]
    assert kinds == [["iban"], [], ["ssn"], [], ["iban"]] and KINDS[:4] == tuple(PLAIN)


def test_masks(spark, awkward, empty):
    texts = ["mail a@b.cc now", "é 10.0.0.1@x.yy!", "none", None]
    rows = masked(with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["mail [EMAIL] now", "é [EMAIL]!", "none", None]
    assert with_spans(awkward).count() == 7 and pii_table(empty).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away home"), (22, "tiny item"), (3, "solo"), (4, None), (5, " .. "), (6, "Tiny, ITEM"), (None, "one two")]


def plain_hits(text, items, size=10):
    def low(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = low(text), set(), set()
    for item, t in items:
        own = low(t)
        for k in range(max(1, len(own) - size + 1) if own and item is not None else 0):
            piece = own[k : k + size]
            for i in range(len(w) - len(piece) + 1):
                if w[i : i + len(piece)] == piece:
                    hit.update(range(i, i + len(piece)))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("max_words", [1_000_000, 8])
def test_contamination_against_brute_force(spark, texts, max_words):
    own = [*texts, "x the QUICK brown-fox jumps over the lazy dog and runs away", "a tiny\nitem; solo tiny item", "quick brown fox jumps over the lazy dog and"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), max_words=max_words).collect()
    table = {r["doc_id"]: r for r in contamination_table(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    for r in rows:
        n, n_hit, items = plain_hits(own[r["doc_id"]], ITEMS)
        assert (r["hits"]["n_words"], sorted(r["hits"]["items"])) == (n, items), r["doc_id"]
        t = table[r["doc_id"]]
        assert (t["n_words"], t["n_hit"], t["n_items"], t["contaminated"]) == (n, n_hit, len(items), n_hit > 0)
        assert t["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_contamination_of_awkward_and_no_documents(spark, awkward, empty):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for most in (1_000_000, 8):
        rows = contaminated(awkward.withColumn("_hits0", F.lit(5)), items, max_words=most)
        assert rows.count() == 7 and {r["_hits0"] for r in rows.collect()} == {5} and rows.columns == [*[c for c in awkward.columns if c != "hits"], "_hits0", "hits"]
        assert contaminated(empty, items, max_words=most).count() == 0
    assert contaminated(awkward, none).filter(F.size("hits.starts") > 0).count() == 0


def test_blocks_are_collected_one_at_a_time(spark):
    rows = spark.createDataFrame(ITEMS, "item_id long, text string")
    blocks = _blocks(rows, "item_id", "text", _n_blocks(rows, "item_id", "text", 8))
    assert iter(blocks) is blocks
    items = [x for b in blocks for x in b]
    assert sorted(items) == sorted((str(i), t) for i, t in ITEMS if i is not None and t is not None)


PAGES = {
    "<html><body><nav><ul><li>Home</li></ul></nav><article><h1>T &amp; t</h1><p>One <b>two\n three<br>four<p>five</article><footer>x</footer>": "T & t\nOne two three four\nfive",
    "<main><p>a</p><div class='cookie-notice'>no</div><div class='content'>b<div>c</div>d</div><form><p>f</p></form></main>": "a\nb\nc\nd",
    "plain &lt;text&gt; only": "plain <text> only",
    "<article><script>var a='</p><p>no</p>';</script><p>yes</p><!-- <p>no</p> --><aside>no</aside><div id=comments><p>no</p></div></article>": "yes",
    "<p>a<p>b</div></p>c": "a\nb\nc",
    "": "", None: "", "<article></article>": "", "<!-- open": "", "<p>1 < 2 & 3</p>": "1 < 2 & 3",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_blocks(page):
    assert "\n".join(s for s, _, marked in parse(page)[0] if not marked) == PAGES[page]


def test_templates_go_by_recurrence(spark):
    rows = []
    for k in range(24):
        host = "a.org" if k < 16 else f"b{k}.org"
        page = f"<body><div><p>Buy our things today</p></div><div><p>Text {k} of its own</p><p>A line that all have</p></div></body>"
        rows.append((k, f"https://{host}/{k}", page))
    rows += [(90, None, rows[0][2]), (91, "no url", rows[0][2]), (92, "https://c.org/", None)]
    for limit in (500_000, 0):
        got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), max_broadcast=limit).collect()}
        assert got[3] == "Text 3 of its own"
        assert got[20] == got[90].replace("Text 0", "Text 20") == "Buy our things today\nText 20 of its own\nA line that all have"
        assert got[92] == "" and len(got) == 27
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_count_distinct_pages(spark):
    story = "<body><div><p>The story</p><ul><li>that mirrors hold</li></ul></div></body>"
    rows = [(k, "https://a.org/", story) for k in range(12)] + [(k, "https://a.org/", f"<div><p>Page {k}</p></div><div>x</div>") for k in range(12, 20)]
    rows += [(k, "https://b.org/", f"<div><p>Page {k}</p></div>" + "<div>Join our club</div>" * (k % 5 < 2)) for k in range(100, 400)]
    rows += [(k, "https://c.org/", "<div><p>Whole text</p></div>" + f"<p> {k}</p>" * (k < 512)) for k in range(500, 513)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "The story\nthat mirrors hold" and got[15] == "Page 15"
    assert got[100] == "Page 100" and got[102] == "Page 102"
    assert got[500] == "500" and got[512] == "Whole text"


class PlainPage(HTMLParser):
    """Blocks of the articles of a page, by another parser and without templates."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "br", "img"}

    def __init__(self, page):
        super().__init__()
        self.blocks, self.text, self.depth, self.skip = [], "", 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if t := " ".join(self.text.split()):
            self.blocks.append(t)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.end()
        self.text += " " * (tag == "br")
        self.depth += tag == "article"
        self.skip += tag in ("aside", "nav", "form", "script", "style")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.end()
        self.depth -= tag == "article"
        self.skip -= tag in ("aside", "nav", "form", "script", "style")

    def handle_data(self, data):
        if self.depth > 0 and self.skip == 0:
            self.text += data


@pytest.fixture(scope="session")
def given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    return spark.read.parquet(path)


def test_given_pages_against_a_plain_version(given_pages):
    got = {r["page_id"]: r["text"] for r in main_text(given_pages).collect()}
    assert got == {r["page_id"]: "\n".join(PlainPage(r["html"] or "").blocks) for r in given_pages.collect()}


def test_templates_alone_remove_the_furniture(spark, given_pages):
    """Without markup and article rules, on hosts with pages enough: the given ones, and one site whose links and adverts vary."""
    site = []
    for k in range(40):
        links = "".join(f"<li><a href='/{x}'>{x} {k}</a></li>" for x in range(k % 4 + 2))
        site.append((k, f"http://site.org/{k}", f"<body><div class=top><ul>{links}</ul></div><article><p>Words {k}</p><p>More {k} words of it</p></article><div class=b>Buy {k} now</div></body>"))
        site.append((100 + k, f"http://other.org/{k}", f"<body><div class=top><ul>{links}</ul></div><div class=c><p>Words {k}</p><p>More {k} words of it</p></div></body>"))
    got = main_text(spark.createDataFrame(site, "page_id long, url string, html string"), markup=False).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Words {k % 100}\nMore {k % 100} words of it" for k, _, _ in site}
    rows = given_pages.withColumn("host", host_of(F.col("url")))
    rows = rows.join(rows.groupBy("host").count().filter("count >= 5"), "host", "left_semi").drop("host")
    whole = {r["page_id"]: r["text"].split("\n") for r in main_text(rows).collect()}
    left = {r["page_id"]: r["text"].split("\n") for r in main_text(rows, markup=False).collect()}
    furniture = sum(sum(m for _, _, m in parse(r["html"])[0]) for r in rows.collect())
    stayed = sum(len(left[k]) - len(whole[k]) for k in whole)
    assert len(whole) > 50 and all(set(whole[k]) <= set(left[k]) for k in whole) and stayed < 0.1 * furniture


def test_pages_with_clashing_names_and_deep_ones(spark):
    rows = [(1, "http://a.org/", "<article><p>x</p></article>", "r", "h", 5, "p"), (None, None, None, None, None, None, None), (1, "http://a.org/", "<article><p>x</p></article>", "r", "h", 5, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, recurring string, host string, text long, row string")
    got = main_text(df).collect()
    assert [r["text"] for r in got if r["page_id"]] == ["x", "x"] and {r["recurring"] for r in got} == {"r", None} and {r["row"] for r in got} == {"p", None}
    deep = "<div>" * 3000 + "<p>end" + "</div>" * 3000
    assert parse("<div>x" * 2000)[1][-1][0] == 1998
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    got = main_text(spark.createDataFrame([(1, "http://a.org", deep), (2, "http://a.org", long)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: len(r["text"]) for r in got} == {1: 3, 2: 249_999}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_a_site_of_rich_templates(spark, limit):
    """Many recurring subtrees, and many blocks around which they are: time is by what the pages hold, not by their products."""
    menu = "".join(f"<div class=m{i}><p>Entry {i}</p></div>" for i in range(2000))
    rows = [(k, "http://rich.org/", f"<body><div>{menu}</div><div class=t><p>Story {k}</p></div></body>") for k in range(64)]
    began = time.perf_counter()
    df = main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), max_broadcast=limit)
    assert {r["page_id"]: r["text"] for r in df.collect()} == {k: f"Story {k}" for k in range(64)}
    assert time.perf_counter() - began < 60 and "array_contains" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_memory_grows_with_the_page_alone():
    code = "import resource, sys; from lociforge.llm.html import all_around, parse; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; b, n = parse('<div>x' * 100_000); all_around(b, n); print(len(b), len(n), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    blocks, nodes, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, env=os.environ).stdout.split())
    assert blocks == nodes == 100_000 and mb < 300


def test_open_inline_elements_cost_no_search():
    began = time.perf_counter()
    assert len(parse("<b>" * 20_000 + "<div>x</div>" * 20_000)[0]) == 20_000
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="session")
def model(tokenizers_dir):
    return tokenizers_dir.path("piece_bpe_32k.model")


ODD = ["  two  spaces ", " ", "\n\n a", "a\x00b c", "tab\there", "日本語 и ещё", "😀😀 x▁y ▁", "é", "a  ", "<s> </s> <0x41>", "1 2  3   4"]


def test_ids_are_those_of_sentencepiece(spark, model, texts):
    import sentencepiece

    own = [t or "" for t in texts] + ODD
    plain_ids = sentencepiece.SentencePieceProcessor(model_file=model).encode(own)
    ids, same = codec(model).encode(own)
    assert ids == plain_ids and same.all()
    rows = encoded(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), model).collect()
    for r in rows:
        expected = plain_ids[r["doc_id"]]
        assert r["ids"] == expected and r["n_tokens"] == len(expected)
        assert r["ids_crc32"] == zlib.crc32(np.array(expected, "<u4").tobytes())
        assert r["parity"]
        assert r["round_trip"] == ("▁" not in own[r["doc_id"]]), own[r["doc_id"]]


def test_decoding_is_that_of_the_library(model, texts):
    own = codec(model)
    ids, _ = own.encode([t or "" for t in texts] + ODD)
    flat, n = np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])
    assert [x.decode() for x in own.decode(flat, n)] == own.whole.decode_batch(ids, skip_special_tokens=False)
    assert own.decode(flat[:0], n[:0]) == [] and own.decode(flat[:0], np.array([0, 0])) == [b"", b""]


def test_long_texts_are_encoded_in_runs(model, texts):
    own = Codec(model, long=50)
    odd = [*[t or "" for t in texts], *ODD, "x " * 100, " " * 300, ("ab  cd   e " * 30) + " ", "y" * 200]
    assert all("".join(runs_of(t, 50)) == t for t in odd) and len(runs_of("x " * 100, 50)) > 2
    ids, same = own.encode(odd)
    assert ids == own.plain.encode(odd) and same.all()


def test_rows_do_not_change_with_the_batches(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate([*texts, *ODD])), "doc_id long, text string")
    one, many = (sorted(map(tuple, encoded(docs.repartition(n), model, ids=False).collect())) for n in (1, 13))
    assert one == many


def test_parity_is_that_of_each_text(model):
    own = Codec(model)
    right = own.plain.encode

    class Wrong:
        def encode(self, texts, **kwargs):
            return [[0] if "other" in t else x for t, x in zip(texts, right(texts, **kwargs))]

    own.plain = Wrong()
    for _ in range(2):  # whatever the worker has met before
        assert own.encode(["one other", "one two", ""])[1].tolist() == [False, True, True]


def test_encoding_of_awkward_and_no_documents(awkward, empty, model):
    assert encoded(awkward, model).count() == 7 and encoded(empty, model).count() == 0


def _message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_a_unigram_model_is_rebuilt():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -3.2, 1), ("ba", -5.5, 1), ("▁ab", -6.9, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0))))
    m = Model.parse(data)
    assert m.kind == 1 and m.byte_fallback and len(m.pieces) == len(pieces) and not m.splits_at_marks()
    own, plain_model = m.tokenizer(), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["ab", "abab ba", "a b  ab", "xa", "bbb aab", "é"]:
        assert own.encode(text).ids == plain_model.encode(text), text


def test_the_pipeline_against_its_plain_version(spark, tmp_path, words, model):
    import sentencepiece

    rng = np.random.default_rng(4)
    clean = [" ".join(rng.choice(words, 90)) for _ in range(40)]
    item, alone = " ".join(rng.choice(words, 14)), " ".join(rng.choice(words, 70))
    texts = [*clean, clean[0], clean[1] + "\n", clean[2] + " " + item, alone + " mail me@here.org or 10.1.2.3", "short", None, *[" | ".join(f"{w.upper()}***!" for w in clean[k].split()) for k in range(4, 10)]]
    pd.DataFrame({"doc_id": [*range(3, 15), 46, 47, 48], "quality": [1] * 12 + [0] * 3}).to_parquet(tmp_path / "labels.parquet")
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "x", "source": "s", "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    names = spark.read.parquet(str(tmp_path / "documents.parquet")).columns
    d = docs_now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == names
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = {k: t for k, t in enumerate(texts[:40])} | {43: alone + " mail [EMAIL] or [IP]"}
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    assert got == {k: processor.encode(t) for k, t in expected.items()}
    assert d.count() == len(texts)


def test_stages_take_awkward_and_no_documents(spark, tmp_path, awkward, empty):
    pd.DataFrame({"item_id": [1], "text": ["never there"]}).to_parquet(tmp_path / "benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward, str(tmp_path)).count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
