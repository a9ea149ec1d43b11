"""Sources, sinks, persistence and grid helpers (file / literal inputs)."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import scalar
from riskframe.operators import models
from riskframe.plans import cascade
from riskframe.sources import patients, sinks

HEART = T.StructType([T.StructField(c, T.DoubleType()) for c in ("age", "trestbps", "chol", "thalch", "oldpeak", "ca")]
                     + [T.StructField(c, T.StringType()) for c in ("sex", "dataset", "cp", "restecg", "slope", "thal",
                                                                    "fbs", "exang")])
PATIENT_A = {"age": 71, "sex": "female", "dataset": "hungary", "cp": "non-anginal", "trestbps": 133, "chol": 247,
             "restecg": "st-t abnormality", "thalch": 121, "oldpeak": 1.4, "ca": 1, "thal": "fixed defect",
             "fbs": "false", "slope": "downsloping", "exang": "true"}
PATIENT_B = {"age": 44, "sex": "male", "dataset": "switzerland", "cp": "atypical angina", "trestbps": 122, "chol": 208,
             "restecg": "normal", "thalch": 164, "oldpeak": 0.3, "ca": 0, "thal": "normal", "fbs": "true",
             "slope": "flat", "exang": "false"}


def test_json_object_and_list(spark):
    d = tempfile.mkdtemp(prefix="rf-json-")
    with open(os.path.join(d, "one.json"), "w") as f:
        json.dump(PATIENT_A, f)
    with open(os.path.join(d, "many.json"), "w") as f:
        json.dump([PATIENT_A, PATIENT_B], f)
    df = patients.scan_patients_json(spark, d, HEART)
    assert df.count() == 3
    assert sorted(r["age"] for r in df.collect()) == [44.0, 71.0, 71.0]


def test_records_and_na_tokens(spark):
    rec = dict(PATIENT_B, thal="NaN", restecg="null")
    row = patients.rows_from_records(spark, [{**rec, "age": float(rec["age"]), "trestbps": float(rec["trestbps"]),
                                              "chol": float(rec["chol"]), "thalch": float(rec["thalch"]),
                                              "ca": float(rec["ca"])}], HEART).first()
    assert row["thal"] is None and row["restecg"] is None and row["age"] == 44.0


def test_csv_na_tokens_and_target_drop(spark):
    d = tempfile.mkdtemp(prefix="rf-csv-")
    path = os.path.join(d, "p.csv")
    with open(path, "w") as f:
        f.write("id,age,sex,num\n1,63,male,1\n2,NA,female,0\n3,40,NaN,\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("age", T.DoubleType()),
                           T.StructField("sex", T.StringType()), T.StructField("num", T.IntegerType())])
    df = patients.scan_patients_csv(spark, path, schema, target="num", drop=["id", "absent"])
    rows = sorted(df.collect(), key=lambda r: r["num"])
    assert len(rows) == 2 and rows[0]["age"] is None and "id" not in df.columns


def test_load_threshold_default_and_value(spark):
    assert sinks.load_threshold(spark, None) == 0.5
    assert sinks.load_threshold(spark, "/nonexistent/metadata.json") == 0.5
    d = tempfile.mkdtemp(prefix="rf-meta-")
    with open(os.path.join(d, "metadata.json"), "w") as f:
        json.dump({"optimal_threshold": 0.226}, f)
    assert sinks.load_threshold(spark, os.path.join(d, "metadata.json")) == pytest.approx(0.226)
    with open(os.path.join(d, "nokey.json"), "w") as f:
        json.dump({"other": 1}, f)
    assert sinks.load_threshold(spark, os.path.join(d, "nokey.json")) == 0.5


def test_results_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rf-out-")
    df = spark.createDataFrame([("KNN", 0.8824), ("CatBoost", 0.902)], "model string, recall double")
    sinks.sink_results_csv(df, os.path.join(d, "cmp"))
    back = spark.read.option("header", True).schema("model string, recall double").csv(os.path.join(d, "cmp"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_model_save_load_round_trip(spark):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from riskframe.operators.search import assemble, score_model
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 2)) for i in range(60)],
                               "id long, a double, b double, y double")
    v = assemble(df, ["a", "b"])
    m = LogisticRegression(labelCol="y").fit(v)
    d = tempfile.mkdtemp(prefix="rf-model-")
    m.write().overwrite().save(os.path.join(d, "lr"))
    m2 = LogisticRegressionModel.load(os.path.join(d, "lr"))
    a = sorted(tuple(r) for r in score_model(m, v, "id").collect())
    b = sorted(tuple(r) for r in score_model(m2, v, "id").collect())
    assert a == b


def test_param_grid_and_log_grid(spark):
    g = models.param_grid_expand({"C": [0.1, 1.0], "penalty": ["l1", "l2"], "depth": [None, 3]})
    assert len(g) == 8 and g[0] == {"C": 0.1, "penalty": "l1", "depth": None}
    pts = [r["value"] for r in scalar.log_grid(spark, 20, -9.0).orderBy("i").collect()]
    assert pts[0] == pytest.approx(1.0) and pts[-1] == pytest.approx(1e-9) and len(pts) == 20


def test_cascade_rejects_and_bands(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.1, 1), (3, 0.9, -1)], "id long, p double, flag int")
    out = {r["id"]: r for r in cascade.score_cascade(df, "id", ["p"], F.col("p"), gate=F.col("flag"),
                                                     threshold=0.226).collect()}
    assert out[1]["risk_level"] == "High Risk" and out[1]["prediction"] == 1
    assert out[2]["risk_level"] == "Low Risk" and out[2]["prediction"] == 0
    assert out[3]["anomaly_flagged"] and out[3]["probability"] is None
    assert out[3]["risk_level"] == "Anomaly - Manual Review"
    with pytest.raises(ValueError):
        cascade.score_cascade(df, "id", ["p", "age"], F.col("p"))


def test_fixed_formatting_matches_printf(spark):
    df = spark.createDataFrame([(0.75955,), (2.675,), (-0.004,), (12.5,)], "x double")
    got = [r[0] for r in df.select(scalar.fmt("x", "%.4f")).collect()]
    assert got == ["%.4f" % v for v in (0.75955, 2.675, -0.004, 12.5)]
    got = [r[0] for r in df.select(scalar.fmt("x", "%+.2f")).collect()]
    assert got == ["%+.2f" % v for v in (0.75955, 2.675, -0.004, 12.5)]
