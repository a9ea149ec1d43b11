"""Permutation importance against a plain version, over many small blocks."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import explain


def _h(seed, text):
    return int(hashlib.md5(f"{seed}|{text}".encode()).hexdigest()[:8], 16)


def _plain(rows, repeats, block):
    rows = sorted(rows, key=lambda r: (_h("42|base", r[0]), r[0]))
    right = lambda y, a, b: None if a is None or b is None else y == int(a + 2 * b > 0)
    mean = lambda x: np.mean([v for v in x if v is not None])
    base = mean([right(*r[1:]) for r in rows])
    out = {}
    for j, name in enumerate("ab"):
        accs = []
        for r in range(repeats):
            ok = []
            for at in range(0, len(rows), block):
                part = rows[at:at + block]
                donors = sorted(part, key=lambda x: (_h(42, f"{name}|{r}|{x[0]}"), str(x[0])))
                for x, d in zip(part, donors):
                    v = list(x[2:])
                    v[j] = d[2 + j]
                    ok.append(right(x[1], *v))
            accs.append(mean(ok))
        out[name] = base - np.mean(accs)
    return out


def test_blocks_equal_a_plain_version_and_rows_are_shuffled_once(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    rows = [(i, int(x[i, 0] + 2 * x[i, 1] + r.normal() / 3 > 0), float(x[i, 0]) if i % 17 else None, float(x[i, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    predict = lambda c: (c["a"] + 2 * c["b"] > 0).cast("int")
    for block in (64, 10_000):
        out = explain.permutation_importance(df, "id", "y", ["a", "b"], predict, repeats=4, block=block)
        got = {k: v for k, v in out.collect()}
        want = _plain(rows, 4, block)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    few, many = (explain.permutation_importance(df, "id", "y", ["a", "b"], predict, repeats=n)._jdf.queryExecution()
                 .executedPlan().toString().count("Exchange hashpartitioning") for n in (1, 9))
    assert few == many
    assert explain.permutation_importance(df.where(F.lit(False)), "id", "y", ["a", "b"], predict).count() == 0
