"""Features, splits and stat-table preprocessing."""
import pytest
from pyspark.sql import functions as F

from riskframe.functions import scalar
from riskframe.operators import features, prep, split


def test_tiny_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = prep.fit_robust(df, ["x"]).first()
    assert r["median"] == pytest.approx(2.5) and r["iqr"] == pytest.approx(3.0)
    s = prep.fit_standard(df, ["x"]).first()
    assert s["sd_pop"] == pytest.approx(3.535534, abs=1e-6)
    scaled = [v[0] for v in prep.apply_robust(df, prep.fit_robust(df, ["x"])).orderBy("x").collect()]
    assert scaled[0] == pytest.approx((1 - 2.5) / 3.0)


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in prep.apply_standard(df, prep.fit_standard(df, ["x"])).collect()] == [0.0, 0.0]
    assert [r[0] for r in prep.apply_robust(df, prep.fit_robust(df, ["x"])).collect()] == [0.0, 0.0]


def test_heart_features_literal_patients(spark):
    a = spark.createDataFrame([(63.0, 145.0, 108.0, 2.2), (150.0, 250.0, 40.0, 6.0)],
                              "age double, trestbps double, thalch double, oldpeak double")
    rows = features.heart_features(a).collect()
    assert rows[0]["max_hr_ratio"] == pytest.approx(0.687898, abs=1e-6)
    assert rows[0]["bp_hr_index"] == pytest.approx(1.342592, abs=1e-6)
    assert rows[0]["age_st_interaction"] == pytest.approx(138.6)
    assert rows[1]["bp_hr_index"] == pytest.approx(6.249998, abs=1e-6)
    with pytest.raises(ValueError):
        features.heart_features(a.drop("oldpeak"))


def test_kidney_features_and_absent_inputs(spark):
    cols = "bp_systolic double, bp_diastolic double, blood_urea_nitrogen double, serum_creatinine double, " \
           "calcium double, phosphorus double, bmi double"
    df = spark.createDataFrame([(160.0, 90.0, 45.0, 3.5, 8.0, 5.5, 32.0)], cols)
    r = features.kidney_features(df).first()
    assert r["pulse_pressure"] == 70 and r["map"] == pytest.approx(113.333333, abs=1e-6)
    assert r["bun_cr_ratio"] == pytest.approx(12.857106, abs=1e-6)
    assert r["ca_p_product"] == pytest.approx(44.0) and r["bmi_bp_interaction"] == pytest.approx(5120.0)
    r2 = features.kidney_features(df.drop("calcium", "bmi")).first()
    assert r2["ca_p_product"] == 0 and r2["bmi_bp_interaction"] == 0


def test_risk_band_and_labels(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.49,), (0.5,), (None,)], "p double")
    got = [r[0] for r in df.select(scalar.risk_band("p")).collect()]
    assert got == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk", None]


def test_one_hot_unseen_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    stats = prep.fit_one_hot(train, ["c"])
    rows = prep.apply_one_hot(test, stats).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    rep = prep.unseen_category_report(test, stats, ["c"]).first()
    assert rep["n_unseen"] == 1


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert prep.fit_mode(df, ["c"]).first()["value"] == "a"


def test_split_is_disjoint_and_stratified(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = split.stratified_split(df, "id", "y", test=0.2, seed=42, n_buckets=16)
    c = {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert c[(1, "test")] == 50 and c[(0, "test")] == 150
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000
    # same answer with a different bucket count and partitioning (pure function of seed and key)
    s2 = split.stratified_split(df.repartition(7), "id", "y", test=0.2, seed=42, n_buckets=3)
    assert sorted(s.collect()) == sorted(s2.collect())
    folds = split.stratified_kfold(df, "id", "y", k=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200] * 5
