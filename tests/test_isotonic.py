"""Isotonic regression against pool-adjacent-violators, item by item."""
import numpy as np
import pytest

from riskframe.operators.isotonic import IsotonicFit, isotonic_fit, minorant


def _pava(p, y):
    xs = np.unique(p)
    s, w = [y[p == x].sum() for x in xs], [(p == x).sum() for x in xs]
    blocks = []
    for k in range(len(xs)):
        blocks.append([s[k], w[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][i] + b[i] for i in range(3)]
    return dict(zip(xs.tolist(), np.concatenate([np.full(n, a / b) for a, b, n in blocks]).tolist()))


def _rows(seed, n, kind):
    r = np.random.default_rng(seed)
    p = r.permutation(n) / n if kind != "ties" else r.integers(0, 12, n) / 12
    chance = {"rising": p**2, "falling": 1 - p, "waves": 0.5 + 0.5 * np.sin(25 * p), "ties": p, "step": (p > 0.5) * 0.9}[kind]
    return p, (r.random(n) < chance).astype(float)


@pytest.mark.parametrize("sizes", [{}, {"scores_per_range": 40, "solve": 30, "slopes": 8}])
def test_equals_pool_adjacent_violators(spark, sizes):
    rows, want = [], {}
    for k, kind in enumerate(("rising", "falling", "waves", "ties", "step")):
        p, y = _rows(k, 400, kind)
        rows += [(kind, float(a), int(b)) for a, b in zip(p, y)]
        want[kind] = _pava(p, y)
    rows += [("one", 0.5, 1), (None, 0.1, 1), (None, 0.2, 0), ("waves", None, 1), ("waves", 0.3, None)]
    want["one"], want[None] = {0.5: 1.0}, {0.1: 0.5, 0.2: 0.5}
    fit = IsotonicFit(spark.createDataFrame(rows, "m string, p double, y int").repartition(4), "y", "p", ["m"], **sizes)
    got = {}
    for x in fit.scores.collect():
        got.setdefault(x["m"], {})[x["p"]] = x["fitted"]
    assert {m: sorted(f) for m, f in got.items()} == {m: sorted(f) for m, f in want.items()}
    for m, f in want.items():
        assert all(got[m][x] == pytest.approx(v, abs=1e-12) for x, v in f.items()), m
    ask = spark.createDataFrame([("rising", -1.0), ("rising", 2.0), ("rising", 0.50001), ("one", 9.0), ("none", 0.1), ("rising", None)], "m string, x double")
    out = {(x["m"], x["x"]): x["cal"] for x in fit.apply(ask.withColumnRenamed("x", "p"), "p", "cal").withColumnRenamed("p", "x").collect()}
    f = want["rising"]
    assert out["rising", -1.0] == pytest.approx(min(f.values())) and out["rising", 2.0] == pytest.approx(max(f.values()))
    low, high = max(x for x in f if x <= 0.50001), min(x for x in f if x >= 0.50001)
    assert min(f[low], f[high]) - 1e-12 <= out["rising", 0.50001] <= max(f[low], f[high]) + 1e-12
    assert out["one", 9.0] == 1.0 and out["none", 0.1] is None and out["rising", None] is None


def test_a_million_rising_scores_are_not_collected(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr(f"id / {n}D as p", f"id / {n}D as y")
    fit = IsotonicFit(df, "y", "p", scores_per_range=1 << 17, solve=200_000)
    x = fit.scores.selectExpr("count(*) as n", "max(abs(fitted - p)) as d").first()
    assert x["n"] == n and x["d"] < 1e-9


def test_no_rows(spark):
    df = spark.createDataFrame([], "p double, y int")
    assert isotonic_fit(df, "y", "p").collect() == []


def test_minorant_of_points():
    assert minorant(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 1, 3])).tolist() == [0, 2, 3]
    assert minorant(np.array([0.0, 1, 2]), np.array([0.0, 1, 2])).tolist() == [0, 2]
