import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm import negatives as m

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def _brute(rows, every=100, low=30, high=90):
    own = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, label, [math.floor(256.0 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, label, v) in enumerate(own):
        if i % every:
            continue
        scored = sorted(((dot(v, w), j, other == label, n) for n, (j, other, w) in enumerate(own) if n != k), key=lambda x: (-x[0], x[1]))
        for p, j, same, _ in [x for x in scored if x[2]][:5]:
            near = [(s, n) for s, n, same, _ in scored if not same and low * p <= 100 * s <= high * p][:10]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(near)]
    return sorted(out)


def _rows(spark, rows, every=100, **limits):
    df = spark.createDataFrame(rows, ROW).withColumn("n", F.lit("x")).withColumn("page", F.lit(1))
    return sorted(map(tuple, m.hard_negatives(df, F.col("vec_id") % every == 0, **limits).collect()))


@pytest.mark.parametrize(("page", "pivots"), [(32, 3), (5000, 16)])
def test_as_all_against_all(spark, page, pivots):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(600):
        k = int(rng.integers(6))
        v = centres[k] + rng.normal(size=12) * rng.choice([0.1, 0.6, 1.5])
        rows.append((i, v.tolist(), int(rng.integers(4)) if i % 5 else k % 4))
    rows += [(i + 1000, [1.0] * 12, i % 3) for i in range(150)]  # copies of one vector
    rows += [(100, rows[3][1], 1), (100, rows[100][1], rows[100][2]), (7, rows[8][1], 2), (1200, [0.0] * 12, 1), (1300, [0.5, -0.25], 2), (1400, [], 1)]
    rows += [(None, rows[1][1], 1), (1500, None, 1), (1600, rows[1][1], None), (1700, [1.0, None] * 6, 1), (1800, [float("nan")] * 12, 1), (1900, [float("inf")] * 12, 1), (-100, rows[9][1], 0)]
    assert _rows(spark, rows, page=page, pivots=pivots) == _brute(rows)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 4e5).tolist(), i % 2) for i in range(60)]
    assert _rows(spark, rows, every=10, page=16) == _brute(rows, every=10)
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|overflow"):
        _rows(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_edges(spark):
    assert _rows(spark, []) == []
    assert _rows(spark, [(0, None, 1)]) == []
    assert _rows(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchors
    assert _rows(spark, [(0, [1.0], 1), (2, [0.5], 2)]) == []  # no positive
    assert _rows(spark, [(0, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2), (4, [-1.0], 2)]) == [(0, 2, 1, 3, 65536, 32768)]
    assert _rows(spark, [(0, [0.0], 1), (1, [0.0], 1), (3, [0.0], 2)]) == [(0, 1, 1, 3, 0, 0)]


def test_brackets_hold():
    rng = np.random.default_rng(8)
    rows = np.repeat(rng.integers(-200, 200, (12, 8)), 25, 0) + rng.integers(-20, 20, (300, 8))
    most = int((rows**2).sum(1).max())
    space = m.Space(m.choose_pivots(rows, most), most)
    d, q = space.of_rows(rows), space.of_anchors(rows[:20])
    scores = rows[:20] @ rows.T
    true = space.distance((rows[:20] ** 2).sum(1)[:, None].astype(float), scores)
    assert (np.abs(q[:, None] - d[None]).max(2) <= true + space.slack).all()
    assert ((q[:, None] + d[None]).min(2) >= true - space.slack).all()
    hopeless = np.abs(q[:, None] - d[None]).max(2) > space.distance((rows[:20] ** 2).sum(1)[:, None].astype(float), np.sort(scores, 1)[:, -5:-4])
    assert hopeless.mean() > 0.5  # rows that are never scored, where rows lie in clusters


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_anchors_meet_in_shares(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(50)) if i % 3 else 7) for i in range(1500)]  # many labels, many equal scores
    rows += [(i, [0.5] * 6, i % 5) for i in range(1500, 2000)]  # one common vector
    monkeypatch.setattr(m, "ANCHORS", 30)
    monkeypatch.setattr(m, "TASKS", 3)
    searched = []
    search = m.search
    monkeypatch.setattr(m, "search", lambda *a: searched.append((a[0], search(*a))) or searched[-1][1])
    assert _rows(spark, rows, every=10, page=16, pivots=4) == _brute(rows, every=10)
    assert len(searched) == 2
    for anchors, found in searched:
        assert "Join" not in _plan(found)  # pages are neither joined nor broadcast
        shares = 2  # 200 anchors are 7 blocks, and 12 tasks are asked for
        wishes = anchors.selectExpr("sum(aggregate(wishes, 0, (a, x) -> a + x.k))").first()[0]
        assert 0 < found.count() <= shares * wishes  # the best of a share, not of each of 125 pages
