import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, z int, n double"


def expected(rows, positives=5, negatives=10):
    ok = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, z) in enumerate(ok):
        if i % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(z, y)), j, m) for b, (j, m, y) in enumerate(ok) if b != a and len(y) == len(z))
        for s, j in [(-s, j) for s, j, m in scores if m == lab][:positives]:
            found = [(k, -t) for t, k, m in scores if m != lab and 30 * s <= -100 * t <= 90 * s][:negatives]
            out += [(i, j, r + 1, k, s, t) for r, (k, t) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, lab, "x", 7, None) for i, v, lab in rows], SCHEMA).repartition(3)
    out = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def _cloud(seed, n, dim=6):
    """Groups of near copies over several labels, a third of all rows in one of them, with exact copies and ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dim)).tolist()
    rows = []
    for k in range(n):
        c = 0 if k % 3 == 0 else int(r.integers(1, 9))
        spread = 0.0 if k % 5 == 0 else 0.2
        rows.append((k * 4, [float(x + spread * r.normal()) for x in centres[c]], int(r.integers(0, 4))))
    return rows


def test_against_all_pairs(spark):
    rows = _cloud(1, 260)
    assert mined(spark, rows, fan=6, leaf=40) == expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.3, 0.3], 2), (3, [0.25, 0.25], None), (4, None, 2), (5, [], 2),
            (6, [None, 1.0], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (None, [0.3, 0.3], 2), (9, [0.3, 0.3, 0.3], 2),
            (200, [0.0, 0.0], 3), (10, [0.0, 0.0], 3), (300, [-0.5, -0.5], 4), (11, [0.5, 0.5], 4), (400, [1.0], 5)]
    got = mined(spark, rows)
    assert got == expected(rows)
    assert {r[0] for r in got} == {100, 200}  # 300 has a negative positive score, 400 no partner
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_repeated_rows_and_nodes_that_cannot_be_parted(spark):
    # one vector under many labels, so that no split point parts it; ties go to the smaller id; an anchor given twice
    rows = [(k, [1.0, 0.5], k % 30) for k in range(120)] + [(500 + k, [0.7, 0.3], 50 + k) for k in range(30)] + [(100, [1.0, 0.5], 10)]
    assert mined(spark, rows, fan=3, leaf=60) == expected(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(100, [3e5, 1e5], 1), (1, [3e5, 1e5 + 1 / 256], 1), (2, [2e5, 1e5], 2), (3, [2e5, 1e5 + 1 / 256], 2)]
    assert mined(spark, rows) == expected(rows)
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e200], 1)])


def test_children_left_out_hold_nothing():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8)) * 300
    rows = np.floor(np.concatenate([c + r.normal(size=(50, 8)) * 20 for c in centres]))
    m2 = float((rows * rows).sum(axis=1).max())
    points = rows[hn.far_apart(rows, 8, m2)]
    d = hn._row_distances(rows, points, m2)
    child = d.argmin(axis=1)
    low = np.array([d[child == c].min(axis=0) for c in range(8)])
    high = np.array([d[child == c].max(axis=0) for c in range(8)])
    asked = np.floor(centres + 1)
    q2 = (asked * asked).sum(axis=1)
    scores = asked @ rows.T
    best = np.sort(scores, axis=1)[:, -10]
    to = np.sqrt(q2[:, None] + m2 - 2 * asked @ points.T)
    inner, outer = hn._radius(scores.max(axis=1), q2, m2), hn._radius(best, q2, m2)
    go = hn.reached(to, low, high, inner, outer, 1e-6 * (np.sqrt(q2) + m2**0.5))
    needed = np.array([[((child == c) & (s >= b)).any() for c in range(8)] for s, b in zip(scores, best)])
    assert (go | ~needed).all()
    assert go.mean() < 0.6  # most siblings of grouped vectors are left out
