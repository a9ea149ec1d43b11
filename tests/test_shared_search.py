"""Shared fits against one fit a point."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import models, search, shared_search
from riskframe.plans import grids


def test_published_grids_have_all_their_points():
    sizes = {p: sum(len(grids.points(p, m)) for m in grids.GRIDS[p]) for p in grids.GRIDS}
    assert sizes == {"heart": 1152, "kidney": 274}


@pytest.fixture(scope="module")
def folds(spark):
    r = np.random.default_rng(8)
    x = r.integers(0, 6, size=(90, 2)).astype(float)  # many ties and equal points
    rows = [(i, int(x[i, 0] + x[i, 1] + r.normal() > 5), float(x[i, 0]), float(x[i, 1]), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, fold int")
    return [(df.where(F.col("fold") != f), df.where(F.col("fold") == f)) for f in range(2)]


def _recall(valid, pred):
    j = valid.where("y = 1").join(pred, "id").agg(F.avg(F.col("pred").cast("double"))).first()[0]
    return j


def test_knn_points_equal_single_runs(spark, folds):
    grid = models.param_grid_expand({"n_neighbors": [1, 4], "weights": ["uniform", "distance"], "p": [1, 2]})
    res = {(r["grid_id"], r["fold"]): r["recall"] for r in shared_search.knn_search(folds, "id", "y", ["a", "b"], grid).collect()}
    assert len(res) == 16
    for f, (tr, va) in enumerate(folds):
        for i in (1, 2, 4, 6, 7):
            g = grid[i]
            one = models.knn_classifier(tr, va, "id", "y", ["a", "b"], g["n_neighbors"], g["weights"], g["p"])
            assert res[i, f] == pytest.approx(_recall(va, one))


def test_nb_points_equal_single_runs(spark, folds):
    grid = [{"var_smoothing": v} for v in (1.0, 0.3, 1e-9)]
    res = shared_search.nb_search(folds, "y", ["a", "b"], grid)
    got = {(r["grid_id"], r["fold"]): r["recall"] for r in res.collect()}
    for f, (tr, va) in enumerate(folds):
        for i, g in enumerate(grid):
            p = models.gaussian_nb_proba(models.gaussian_nb_fit(tr, "y", ["a", "b"], g["var_smoothing"]))
            assert got[i, f] == pytest.approx(_recall(va, va.select("id", (p > 0.5).cast("int").alias("pred"))))
    assert search.grid_results_rank(res).first()["mean_recall"] == pytest.approx(max(np.mean([got[i, f] for f in (0, 1)]) for i in range(3)))
