"""End-to-end jobs on the heart stand-in: train → evaluate → score literal patients."""
import json
import os
import tempfile

import pytest

from riskframe.plans import jobs, model_store
from riskframe.profiles import HEART
from riskframe.sources import sinks, standins
from riskframe.streaming import model_stream

from conftest import SF001
from test_sources import PATIENT_A, PATIENT_B

PATIENT_C = dict(PATIENT_B, age=91, trestbps=96, chol=512, thalch=77, oldpeak=4.8, ca=2, cp="asymptomatic")


def test_train_evaluate_score(spark):
    d = tempfile.mkdtemp(prefix="rf-jobs-")
    csv = os.path.join(d, "heart.csv")
    cols = [f.name for f in HEART.schema().fields if f.name in standins.heart_obs(spark, SF001).columns]
    standins.heart_obs(spark, SF001).select(*cols).write.option("header", True).csv(csv)
    model_dir = os.path.join(d, "model")
    jobs.train(spark, csv, HEART, model_dir, n_estimators=10)
    doc = jobs.evaluate(spark, csv, HEART, model_dir, os.path.join(d, "metrics"))
    assert 0.0 <= doc["brier_score"] <= 1.0
    assert set(doc["bootstrap_confidence_intervals"]) == {"recall", "roc_auc", "pr_auc"}
    assert sinks.load_threshold(spark, os.path.join(model_dir, "metadata.json"), default=-1.0) == doc["optimal_threshold"]
    pj = os.path.join(d, "patients")
    os.makedirs(pj)
    # a patient without an id, one that lacks both columns that every donor has
    nameless, bare = dict(PATIENT_C), dict(PATIENT_B, id=4, age=None, oldpeak=None)
    with open(os.path.join(pj, "p.json"), "w") as f:
        json.dump([dict(PATIENT_A, id=1), dict(PATIENT_B, id=2), nameless, bare], f)
    rows = jobs.score(spark, pj, HEART, model_dir).collect()
    assert sorted((r["id"] is None, r["id"]) for r in rows) == [(False, 1), (False, 2), (False, 4), (True, None)]
    for r in rows:
        if r["anomaly_flagged"]:
            assert r["risk_level"] == "Anomaly - Manual Review" and r["heart_disease_probability"] is None
        else:
            assert 0.0 <= r["heart_disease_probability"] <= 1.0
    single = jobs.predict_single(spark, dict(PATIENT_A, id=1), HEART, model_dir)
    assert single == next(r for r in rows if r["id"] == 1).asDict()
    # the same patients as a stream
    landing, out = os.path.join(d, "landing"), os.path.join(d, "scored")
    os.makedirs(landing)
    lines = [json.dumps(p) for p in (dict(PATIENT_A, id=1), dict(PATIENT_B, id=2), nameless, bare)]
    with open(os.path.join(landing, "a.jsonl"), "w") as f:
        f.write("\n".join([*lines, "{broken", ""]))
    jobs.score_stream(spark, landing, HEART, model_dir, out)
    got = model_stream.read_scored(spark, out).drop("batch").select(*rows[0].__fields__).collect()
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert [r["reason"] for r in model_stream.read_quarantine(spark, out).collect()] == ["not a JSON object"]
    # a run that dies before its last part leaves the version in use
    before = model_store.current(spark, model_dir)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jobs, "fold_tables", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.train(spark, csv, HEART, model_dir, n_estimators=10)
    assert model_store.current(spark, model_dir) == before and len(os.listdir(os.path.join(model_dir, "versions"))) == 2
    short = os.path.join(d, "short")
    os.makedirs(short)
    with open(os.path.join(short, "p.json"), "w") as f:
        json.dump({k: v for k, v in PATIENT_A.items() if k != "chol"}, f)
    with pytest.raises(ValueError, match="chol"):
        jobs.score(spark, short, HEART, model_dir)
