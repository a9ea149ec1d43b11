"""DBSCAN: what is compared beyond a point's own cell stays small, and the result equals brute force."""
import numpy as np
import pytest

from riskframe.operators import density


def _brute(ids, x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label = near.sum(1) >= least, {}
    for i in np.argsort(ids):
        if core[i] and ids[i] not in label:
            seen, stack = {i}, [i]
            while stack:
                new = set(np.flatnonzero(near[stack.pop()] & core)) - seen
                seen |= new
                stack += new
            label.update({ids[j]: ids[i] for j in seen})
    for i in np.flatnonzero(~core):
        label[ids[i]] = min((label[ids[j]] for j in np.flatnonzero(near[i] & core)), default=-1)
    return {int(k): int(v) for k, v in label.items()}


@pytest.mark.parametrize("eps, least", [(1.0, 5), (0.25, 6), (0.02, 2)])
def test_few_points_look_beyond_their_cell(spark, monkeypatch, eps, least):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(900, 2)), r.normal(size=(300, 2)) * 0.2 + 7, r.uniform(-12, 12, size=(60, 2)), np.full((40, 2), 9.0)])
    ids = r.permutation(len(x)) + 3
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "id long, a double, b double")
    visits, write = [], density.materialize

    def counted(t, tag):
        t = write(t, tag)
        if tag == "density-asked":
            visits.append(t.selectExpr("sum(size(cells))").first()[0] or 0)
        return t

    monkeypatch.setattr(density, "materialize", counted)
    got = {q["id"]: q["cluster"] for q in density.density_clusters(df, "id", ["a", "b"], eps, least, cell_rows=10).collect()}
    assert got == _brute(ids, x, eps, least)
    # about 130 cells, at the widest eps most of them within reach of each other
    assert visits and sum(visits) < 12 * len(x)
