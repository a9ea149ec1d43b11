import numpy as np
import pytest
from riskframe.operators import anomaly


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(8).normal(size=(400, 2)) * [1.0, 3.0]
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double").cache()


def test_one_class_svm_is_solved(points):
    nu = 0.1
    got = anomaly.one_class_svm(points, "id", ["x", "y"], nu=nu, n_components=8).collect()
    s = np.array([r["score"] for r in got])
    # by complementary slackness the νn rows of largest score lie outside
    assert abs((s > 0).mean() - nu) < 0.01
    with pytest.raises(RuntimeError):
        anomaly.one_class_svm(points, "id", ["x", "y"], nu=nu, n_components=8, max_steps=1)


def test_elliptic_envelope_ends_at_a_fixpoint(points):
    with pytest.raises(RuntimeError):
        anomaly.elliptic_envelope(points, "id", ["x", "y"], max_steps=1)
    d = {r["id"]: r["score"] for r in anomaly.elliptic_envelope(points, "id", ["x", "y"]).collect()}
    x = {r["id"]: (r["x"], r["y"]) for r in points.collect()}
    # normal rows: the reweighted estimate is close to the plain one, here with spreads 1 and 3
    want = {i: v[0] ** 2 + (v[1] / 3) ** 2 for i, v in x.items()}
    assert all(0.6 * want[i] - 0.3 < d[i] < 1.6 * want[i] + 0.3 for i in d)


def test_min_norm_weights():
    p = np.array([[1.0, 1.0], [1.0, -1.0], [3.0, 0.0]])
    assert np.allclose(anomaly.min_norm_weights(p), [0.5, 0.5, 0.0])


def test_keyed_bijection_permutes():
    from riskframe.functions.rng import KeyedBijection
    for n in (1, 2, 3, 5, 16, 17, 1000, 4099):
        image = KeyedBijection(n, 7, 1)(np.arange(n))
        assert sorted(image) == list(range(n))
    a, b = (KeyedBijection(10_000, 42, t)(np.arange(256)) for t in (0, 1))
    assert len(set(a)) == 256 and len(set(a) & set(b)) < 40
    seen = np.concatenate([KeyedBijection(1000, 42, t)(np.arange(50)) for t in range(400)])
    counts = np.bincount(seen, minlength=1000)  # 20 expected for each number
    assert 0.8 < (counts.var() / (20 * 0.95)) < 1.25 and abs(seen.mean() - 499.5) < 8


def test_forest_samples_have_exact_sizes(spark):
    for n in (0, 1, 30, 700):
        df = spark.range(n).selectExpr("id", "double(id * 7919 % 101) as a", "double(id % 13) as b")
        nodes = anomaly.iforest_fit(df, "id", ["a", "b"], trees=12, sample=64).where("node = 0").collect()
        assert len(nodes) == (12 if n else 0) and all(r["size"] == min(n, 64) for r in nodes)


def test_envelope_withstands_a_third_of_far_outliers(spark):
    r = np.random.default_rng(5)
    good, far = r.normal(size=(420, 3)), r.normal(size=(180, 3)) * 0.2 + [9.0, 9.0, -9.0]
    rows = [(k, *map(float, v)) for k, v in enumerate(np.r_[good, far])] + [(900, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    score = {x["id"]: x["score"] for x in anomaly.elliptic_envelope(df, "id", ["a", "b", "c"]).collect()}
    assert score.pop(900) is None
    assert min(score[k] for k in range(420, 600)) > 10 * np.quantile([score[k] for k in range(420)], 0.99)
    # the plain distance, from all rows, is held by the outliers
    plain = {x["id"]: x["mahalanobis"] for x in anomaly.mahalanobis(df.where("id < 900"), "id", ["a", "b", "c"]).collect()}
    assert max(plain[k] for k in range(420, 600)) < max(plain[k] for k in range(420))


def test_empty_and_constant_tables(spark):
    none = spark.createDataFrame([], "id long, a double, b double")
    for fn in (anomaly.mahalanobis, anomaly.elliptic_envelope, anomaly.one_class_svm):
        assert fn(none, "id", ["a", "b"]).collect() == []
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(20)], "id long, a double, b double")
    assert {x["mahalanobis"] for x in anomaly.mahalanobis(same, "id", ["a", "b"]).collect()} == {0.0}
    assert {x["score"] for x in anomaly.elliptic_envelope(same, "id", ["a", "b"]).collect()} == {0.0}
