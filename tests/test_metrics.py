"""Metric operators on the literal fixtures of FIXTURES.md."""
import pytest
from pyspark.sql import functions as F

from riskframe.operators import curves, metrics


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(i, p, y) for i, (p, y) in enumerate(zip([.9, .8, .7, .4, .3, .2], [1, 0, 1, 1, 0, 0]))]
    return spark.createDataFrame(rows, "id long, p double, y int")


def test_roc_auc_and_step_ap(tiny):
    r = curves.summarize_curve(curves.curve_table(tiny, "y", "p")).first()
    assert r["roc_auc"] == pytest.approx(7 / 9, abs=1e-9)
    assert r["pr_auc"] == pytest.approx(0.805556, abs=1e-6)  # step AP, not interpolated (0.763889)


def test_pr_curve_counts(tiny):
    pr = {r["threshold"]: r for r in curves.pr_curve(tiny, "y", "p").collect()}
    assert pr[0.7]["tp"] == 2 and pr[0.7]["fp"] == 1
    assert pr[0.2]["recall"] == pytest.approx(1.0)
    assert pr[0.9]["precision"] == pytest.approx(1.0)


def test_cost_optimal_threshold_lowest_on_ties(spark):
    # two thresholds with identical cost: the lower one wins
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.5, 0), (0.4, 0)], "p double, y int")
    r = curves.cost_optimal_threshold(df, "y", "p").first()
    assert r["threshold"] == pytest.approx(0.8)
    assert r["cost"] == pytest.approx(0.0)


def test_core_metrics_zero_division_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0, 0), (0.2, 0, 0)], "p double, y int, pred int")
    r = metrics.core_metrics(df, "y", "pred", "p").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0
    assert r["roc_auc"] is None  # one class: undefined, not an error


def test_confusion_and_threshold_simulation(tiny):
    s = tiny.withColumn("pred", metrics.apply_threshold("p", 0.5))
    cm = metrics.confusion_matrix(s, "y", "pred").first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (2, 1, 1, 2)
    sim = {r["threshold"]: r for r in metrics.threshold_simulation(tiny, "y", "p").collect()}
    assert sim[0.5]["tp"] == 2 and sim[0.5]["healthy_flagged_rate"] == "33.333%"
    assert sim[0.9]["fp"] == 0


def test_simulation_rate_guard(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 1)], "p double, y int")
    rates = {r["healthy_flagged_rate"] for r in metrics.threshold_simulation(df, "y", "p").collect()}
    assert rates == {"0.000%"}


def test_brier_and_calibration_curve(tiny):
    b = metrics.brier_score(tiny, "y", "p").first()[0]
    exp = sum((p - y) ** 2 for p, y in zip([.9, .8, .7, .4, .3, .2], [1, 0, 1, 1, 0, 0])) / 6
    assert b == pytest.approx(exp)
    cc = metrics.calibration_curve(tiny, "y", "p", bins=2).orderBy("bin").collect()
    assert [r["n"] for r in cc] == [3, 3]


def test_rank_models_golden_order(spark):
    # published comparison rows (model, recall, precision): ties resolved by name
    rows = [("KNN", .8824, .8571), ("Decision Tree", .6667, .8608), ("Logistic Regression", .8529, .8365),
            ("Naive Bayes", .8725, .8558), ("Neural Network", .8627, .8224), ("Random Forest", .8725, .8558),
            ("XGBoost", .8725, .8558), ("CatBoost", .9020, .8440)]
    df = spark.createDataFrame(rows, "model string, recall double, precision double")
    assert metrics.rank_models(df).first()["model"] == "CatBoost"
    order = [r["model"] for r in df.orderBy(F.col("recall").desc(), F.col("precision").desc(), "model").collect()]
    assert order[:5] == ["CatBoost", "KNN", "Naive Bayes", "Random Forest", "XGBoost"]


def test_partition_invariance(spark):
    from riskframe.sources import standins
    s = standins.scored(spark, "/root/testdata/sf0.001").withColumn("pred", metrics.apply_threshold("p", 0.5))
    a = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
               for r in metrics.core_metrics(s, by=["m"]).collect())
    for n in (1, 7):
        b = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in metrics.core_metrics(s.repartition(n), by=["m"]).collect())
        assert a == b


def test_two_phase_prefix_equals_single_phase(spark):
    from riskframe.sources import standins
    s = standins.scored(spark, "/root/testdata/sf0.001")
    one = {(r["m"], r["threshold"]): (r["tp"], r["n"], r["tt"]) for r in
           curves.curve_table(s, "y", "p", by=["m"], n_buckets=1).collect()}
    many = {(r["m"], r["threshold"]): (r["tp"], r["n"], r["tt"]) for r in
            curves.curve_table(s, "y", "p", by=["m"], n_buckets=9).collect()}
    assert one == many and len(one) > 100


def test_bootstrap_iterations_match_weighted_brute_force(spark):
    import numpy as np
    from riskframe.operators import bootstrap
    rows = [(i, round((i * 37 % 100) / 100.0, 2), int((i * 37 % 100) > 40 if i % 5 else (i % 3 == 0)))
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, p double, y int").withColumn("pred", metrics.apply_threshold("p", 0.5))
    w = bootstrap.bootstrap_weights(df, "y", "pred", "p", n_iterations=25, seed=7)
    it = {r["b"]: r for r in bootstrap.bootstrap_iterations(df, "y", "pred", "p", n_iterations=25, seed=7).collect()}
    given = {r["b"]: r for r in bootstrap.iteration_metrics(w, 25, cells_per_range=30).collect()}  # weights given, several ranges
    assert set(it) == set(given) and all(it[b][c] == pytest.approx(given[b][c]) for b in it for c in ("recall", "roc_auc", "pr_auc"))
    from pyspark.sql import functions as F
    wt = w.select("p", "y", "pred", F.posexplode("w").alias("b", "w")).toPandas()
    for b, g in wt.groupby("b"):
        p_ = np.repeat(g["p"].to_numpy(), g["w"].to_numpy())
        y_ = np.repeat(g["y"].to_numpy(), g["w"].to_numpy())
        pr_ = np.repeat(g["pred"].to_numpy(), g["w"].to_numpy())
        if y_.min() == y_.max():
            assert b not in it
            continue
        pos, neg = p_[y_ == 1], p_[y_ == 0]
        auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
        order = np.argsort(-p_, kind="stable")
        ap = 0.0
        for t in np.unique(p_)[::-1]:
            sel = p_ >= t
            ap += ((y_ == 1) & (p_ == t)).sum() / len(pos) * (y_[sel].sum() / sel.sum())
        assert it[b]["recall"] == pytest.approx(((pr_ == 1) & (y_ == 1)).sum() / len(pos))
        assert it[b]["roc_auc"] == pytest.approx(auc)
        assert it[b]["pr_auc"] == pytest.approx(ap)
        del order


def test_poisson_draws_are_deterministic_and_unbiased():
    import numpy as np
    from riskframe.operators.bootstrap import cell_weights
    a = cell_weights(np.array([3.0, 250.0]), np.array([11, -5]), 20000)
    b = cell_weights(np.array([3.0, 250.0]), np.array([11, -5]), 20000)
    assert all((x == y).all() for x, y in zip(a, b))
    assert a[0].mean() == pytest.approx(3.0, rel=0.03) and a[0].var() == pytest.approx(3.0, rel=0.06)
    assert a[1].mean() == pytest.approx(250.0, rel=0.01)


def test_metrics_document_makes_the_scores_once(spark, monkeypatch):
    from riskframe.plans import catalog
    made = []
    monkeypatch.setattr(catalog, "materialize", lambda df, tag="t", real=catalog.materialize: made.append(tag) or real(df, tag))
    assert catalog.q_metrics_document(spark, "/root/testdata/sf0.001").count() == 3
    assert made[0] == "doc-scored"
