"""The near-duplicate stage of the pipeline against a plain look at all pairs."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lociforge.llm import similar
from lociforge.llm.similar import may_be_similar, one_of_similar, sketch


def plain_kept(texts):
    """doc_ids that stay: the first of each component of texts with 4/5 of their 5-word shingles in common."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if (5 * len(a & b) >= 4 * len(a | b)) and label[j] > label[i]:
                    label[j], changed = label[i], True
    return {i for i, x in enumerate(label) if x == i}


def _changed(rng, words, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(words) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(words):
    """Texts, copies with a few words changed (similar, and just not), chains of copies, a passage that many have."""
    rng = random.Random(9)
    base = [" ".join(rng.choices(words, k=rng.randint(60, 250))) for _ in range(12)]
    out = list(base)
    for k, t in enumerate(base):
        out += [_changed(rng, words, t, n) for n in range(1, 2 + k % 6)]
    for _ in range(8):
        out.append(_changed(rng, words, out[-1], 3))
    passage = " ".join(rng.choices(words, k=60))
    out += [" ".join(rng.choices(words, k=k)) + " " + passage for k in range(2, 30, 3)]
    return [*out, base[0].upper(), base[1] + "\n", "one two", "One two", "", None]


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in one_of_similar(docs).collect()}


def test_similar_texts_against_all_pairs(spark, copies):
    expected = plain_kept(copies)
    assert _kept(spark, copies) == expected and 20 < len(expected) < len(copies) - 20


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 1 << 30))
def test_sketches_lose_no_similar_pair(common, one, two, seed):
    own = np.random.default_rng(seed).integers(0, 1 << 63, common + one + two, np.uint64)
    a, b = np.unique(own[: common + one]), np.unique(np.concatenate([own[:common], own[common + one :]]))
    if 5 * common >= 4 * (common + one + two):
        assert may_be_similar(sketch(a), sketch(b), len(a) + len(b))


def test_sketches_tell_most_pairs_apart():
    sets = np.random.default_rng(1).integers(0, 1 << 63, (40, 300), np.uint64)
    assert not any(may_be_similar(sketch(a), sketch(b), 600) for a in sets for b in sets if a is not b and (a != b).any())


@pytest.mark.parametrize("hot", [2, 3, 64])
def test_counts_of_tokens(spark, hot):
    """What is settled within a task and what meets by token give the counts of a plain look."""
    rng = np.random.default_rng(3)
    sets = {k: np.unique(rng.integers(0, 40, 12).astype(np.uint64) << np.uint64(50)) for k in range(30)}
    rows = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "k long, own binary").repartition(3)
    got = {}
    for r in similar._counted(rows, lambda b: ((k, np.frombuffer(x.as_buffer(), np.uint64)) for k, x in zip(b["k"].to_pylist(), b["own"])), hot).collect():
        for t, n in zip(np.frombuffer(r["tokens"], "<u8").tolist(), np.frombuffer(r["counts"], "<i4").tolist()):
            got[r["k"], t] = max(n, got.get((r["k"], t), 0))
    plain = {t: sum(t in x for x in sets.values()) for t in {int(t) for x in sets.values() for t in x}}
    assert got.keys() == {(k, int(t)) for k, x in sets.items() for t in x if plain[int(t)] > 1}
    assert all(min(n, hot) == min(plain[t], hot) for (_, t), n in got.items())


def test_counts_take_a_row_for_each_text_however_many_partitions(spark):
    """What meets by token comes back as a row for a text, not one for each text and partition."""
    rng = np.random.default_rng(4)
    sets = {k: np.unique(rng.integers(0, 90, 40).astype(np.uint64) << np.uint64(20)) for k in range(50)}
    rows = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "k long, own binary")
    of = lambda b: ((k, np.frombuffer(x, np.uint64)) for k, x in zip(b["k"].to_pylist(), b["own"].to_pylist()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        got = similar._counted(rows, of, 64).collect()
        numbers = {r["k"]: r["c"] for r in similar._counted(rows, of, 64, numbers=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r["k"] for r in got) == sorted(sets) and numbers == {r["k"]: len(r["tokens"]) // 8 for r in got}


class _Task:
    """Stands for a DataFrame whose one task is run here."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_a_task_that_counts_holds_a_bounded_part_of_its_tokens():
    def sets_of(batch):
        return ((k, np.random.default_rng(k).integers(0, 1 << 63, 10_000, np.uint64)) for k in range(400))

    task = similar._shipped(_Task(), sets_of, 12, 64)
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in task.run(iter([None] * 1)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 12 and peak < 256 << 20  # of 4 million tokens


@pytest.mark.parametrize("name,value", [("SHOWN", (1, 4)), ("SHOWN", (1, 1)), ("HOT", 2), ("HELD", 1), ("MAX_BROADCAST", 0), ("FEW", 1000), ("MEMBERS", 3), ("GROUP", 3)])
def test_bounds_move_no_result(spark, copies, monkeypatch, name, value):
    monkeypatch.setattr(similar, name, value)
    if name in ("MEMBERS", "GROUP"):
        monkeypatch.setattr(similar, "FEW", 2)
    assert _kept(spark, copies) == plain_kept(copies)


@pytest.mark.parametrize("universe", [40, 4000])
def test_common_elements_of_all_pairs(universe, monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 128)
    rng = np.random.default_rng(universe)
    sets = [np.unique(rng.integers(0, universe, rng.integers(0, 90)).astype(np.uint64)) for _ in range(60)]
    both = similar.common(sets)
    assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j or len(a) == 0)
    assert similar.common([]).shape == (0, 0)


def test_blocks_join_what_is_similar_with_few_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 140).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(140) < rng.choice([0.03, 0.1, 0.2]), rng.integers(1 << 41, 1 << 42, 140).astype(np.uint64), base)) for _ in range(120)]
    keys, parts = rng.permutation(1000)[:120], np.arange(120)
    links = similar.joining(keys, parts, np.zeros(120, int), sets)
    label = dict(zip(keys.tolist(), keys.tolist()))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert a > b and root(a) != root(b)  # no link too many
        label[root(a)] = root(b)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x = len(np.intersect1d(a, b))
            if 5 * x >= 4 * (len(a) + len(b) - x):
                assert root(keys[i]) == root(keys[j])
    side = np.repeat([1, 2], 60)
    across = similar.joining(keys, parts, side, sets)
    of = dict(zip(keys.tolist(), side.tolist()))
    assert across and all(of[a] != of[b] for a, b in across)


def test_rows_grow_with_the_copies_of_a_template(spark, words, monkeypatch):
    """Copies of one text with words changed in each, most pairs too far apart: what is verified grows with the texts."""
    rng = random.Random(21)
    base = " ".join(rng.choices(words, k=150))
    made, verified = {}, similar._verified

    def counting(sets, slim, pairs):
        made[n] = made.get(n, 0) + pairs.count()
        return verified(sets, slim, pairs)

    monkeypatch.setattr(similar, "_verified", counting)
    for n in (150, 600):
        texts = [_changed(rng, words, base, rng.choice([1, 3, 7])) for _ in range(n)]
        kept = _kept(spark, texts)
        assert kept == plain_kept(texts) if n == 150 else len(kept) < n
        assert made[n] <= 6 * n


def test_the_stage_drops_copies_with_a_few_words_changed(spark, tmp_path, words):
    rng = random.Random(3)
    base = [" ".join(rng.choices(words, k=150)) for _ in range(6)]
    texts = [*base, *(_changed(rng, words, t, 3) for t in base)]
    pd.DataFrame({"doc_id": range(12), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == set(range(6))


def test_awkward_and_no_documents(awkward, empty):
    kept = one_of_similar(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 5").count() == 1
    assert one_of_similar(empty).count() == 0


def test_repeated_rows_and_rows_without_ids(spark):
    text, other = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(None, text), (None, text.upper()), (4, other), (4, other), (4, other.upper()), (7, other), (4, "alone"), (None, "")]
    kept = one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["text"].lower()) for r in kept) == sorted([(True, text.lower()), (False, other.lower()), (False, "alone"), (True, "")])
