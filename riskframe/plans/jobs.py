"""Train / evaluate / score jobs (``python -m riskframe.plans.jobs …`` or spark-submit).

train     CSV → engineer → stratified split → fit preprocessing on train (kNN
          impute, robust scale, mode impute, one-hot) → boosted trees in the
          profile's role → 3-fold isotonic calibration → (heart) anomaly gate:
          kNN impute → standard scale → isolation forest → 5 % cut.
          Everything fitted is one version below the model folder (a saved preprocessing
          pipeline, MLlib models, parquet tables), put into use by a manifest at the end.
evaluate  Re-split identically (hash split), score the test rows, metrics at 0.5,
          cost-optimal threshold, metrics there, Brier, bootstrap intervals →
          metrics JSON + metadata.json with ``optimal_threshold``.
score     JSON patients → cascade (gate if the profile has one) → parquet.
stream    The same on files of JSON lines as they land, with a commit log and a quarantine.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators import anomaly, bootstrap, curves, metrics, prep, split
from riskframe.operators.isotonic import IsotonicFit, apply_steps
from riskframe.operators.models import boosted_trees
from riskframe.operators.quantiles import exact_quantiles
from riskframe.operators.search import assemble, fold_tables, score_model
from riskframe.operators.smote import smote
from riskframe.plans import cascade, model_store
from riskframe.plans.preparation import preparation
from riskframe.profiles import PROFILES, Profile
from riskframe.session import materialize
from riskframe.sources import patients, sinks
from riskframe.streaming import model_stream


def _p(model_dir: str, name: str) -> str:
    return os.path.join(model_dir, name)


def load_labelled(spark: SparkSession, csv: str, prof: Profile) -> DataFrame:
    df = patients.scan_patients_csv(spark, csv, prof.schema(), target=prof.target, drop=prof.drop)
    df = df.withColumn("y", (F.col(prof.target) > 0).cast("int") if prof.binarize else F.col(prof.target).cast("int"))
    return df


def prep_apply(df: DataFrame, model: PipelineModel) -> tuple[DataFrame, list[str]]:
    """(model inputs, their names) of raw patients."""
    encoder = model.stages[-1]
    return model.transform(df), [*model.stages[1].getInputCols(), *encoder.names()]


def calibrated_probability(vec: DataFrame, key: str, model_dir: str, cv: int = 3) -> DataFrame:
    """(key, p_raw, p): the model of all training rows, and the mean of the cv isotonic-calibrated fold models."""
    from pyspark.ml.classification import GBTClassificationModel
    parts = []
    for i in range(cv):
        m = GBTClassificationModel.load(_p(model_dir, f"fold{i}"))
        steps = vec.sparkSession.read.parquet(_p(model_dir, f"iso{i}"))
        parts.append(apply_steps(score_model(m, vec, key), "p", f"cal{i}", steps).select(key, f"cal{i}"))
    j = parts[0]
    for o in parts[1:]:
        j = j.join(o, key)
    mean = sum((F.col(f"cal{i}") for i in range(1, cv)), F.col("cal0")) / F.lit(float(cv))
    raw = score_model(GBTClassificationModel.load(_p(model_dir, "raw")), vec, key)
    return raw.select(key, F.col("p").alias("p_raw")).join(j.select(key, mean.alias("p")), key)


def gate_flags(df: DataFrame, prof: Profile, model_dir: str) -> DataFrame:
    """(key, flag): −1 when the isolation-forest score exceeds the fitted 5 % cut."""
    spark = df.sparkSession
    num = prof.features_numeric
    derive, impute = PipelineModel.load(_p(model_dir, "prep")).stages[:2]
    x = impute.transform(derive.transform(df))
    x = prep.apply_standard(x, spark.read.parquet(_p(model_dir, "gate_standard")))
    nodes = spark.read.parquet(_p(model_dir, "gate_nodes"))
    s = anomaly.iforest_score(x, prof.key, num, nodes)
    cut = spark.read.parquet(_p(model_dir, "gate_cut")).first()["cut"]
    return s.select(prof.key, F.when(F.col("score") > F.lit(cut), F.lit(-1)).otherwise(F.lit(1)).alias("flag"))


def train(spark: SparkSession, csv: str, prof: Profile, model_dir: str, n_estimators: int = 50) -> None:
    df = load_labelled(spark, csv, prof)
    s = split.stratified_split(df, prof.key, "y", test=0.2, seed=42)
    tr = s.where(F.col("split") == "train")
    store, model_dir = model_dir, model_store.new_version(model_dir)
    prepared = preparation(prof).fit(tr)
    prepared.write().save(_p(model_dir, "prep"))
    x, names = prep_apply(tr, prepared)
    x = materialize(x.select(prof.key, "y", *names), "train-encoded")

    def balanced(rows: DataFrame) -> DataFrame:
        """Training rows with synthetic minority rows between neighbours; validation rows are never resampled."""
        return smote(rows.select(prof.key, "y", *names), prof.key, "y", names, k=5, seed=42) if prof.resample else rows

    folds = fold_tables(x, prof.key, "y", names, k=3, seed=42, resample=balanced)
    whole = assemble(balanced(x).withColumn("y", F.col("y").cast("double")), names).select("y", "features")
    boosted_trees(prof.booster_role, n_estimators=n_estimators).setLabelCol("y").fit(
        materialize(whole, "train-whole")).write().overwrite().save(_p(model_dir, "raw"))
    for i, (ftr, fva) in enumerate(folds):
        m = boosted_trees(prof.booster_role, n_estimators=n_estimators).setLabelCol("y").fit(
            ftr.withColumn("y", F.col("y").cast("double")))
        m.write().overwrite().save(_p(model_dir, f"fold{i}"))
        IsotonicFit(score_model(m, fva, prof.key, "y"), "y", "p").steps.write.mode("overwrite").parquet(_p(model_dir, f"iso{i}"))
    if prof.gate:
        num = prof.features_numeric
        derive, impute = prepared.stages[:2]
        imp = impute.transform(derive.transform(tr))
        std = prep.fit_standard(imp, num)
        std.write.mode("overwrite").parquet(_p(model_dir, "gate_standard"))
        z = prep.apply_standard(imp, spark.read.parquet(_p(model_dir, "gate_standard")))
        nodes = anomaly.iforest_fit(z, prof.key, num, trees=100, sample=256, seed=42)
        nodes.write.mode("overwrite").parquet(_p(model_dir, "gate_nodes"))
        sc = anomaly.iforest_score(z, prof.key, num, spark.read.parquet(_p(model_dir, "gate_nodes")))
        exact_quantiles(sc, "score", [0.95]).select(F.col("q")[0].alias("cut")).write.mode("overwrite").parquet(_p(model_dir, "gate_cut"))
    model_store.publish(spark, store, model_dir, profile=prof.name)


def evaluate(spark: SparkSession, csv: str, prof: Profile, model_dir: str, out_json: str) -> dict:
    df = load_labelled(spark, csv, prof)
    te = split.stratified_split(df, prof.key, "y", test=0.2, seed=42).where(F.col("split") == "test")
    version = model_store.current(spark, model_dir)
    x, names = prep_apply(te, PipelineModel.load(_p(version, "prep")))
    p = calibrated_probability(assemble(x, names), prof.key, version)
    scored = te.select(prof.key, "y").join(p, prof.key).withColumn("pred", metrics.apply_threshold("p", 0.5))
    opt = curves.cost_optimal_threshold(scored, "y", "p")
    t = opt.first()["threshold"]
    at_opt = scored.withColumn("pred", metrics.apply_threshold("p", t))
    doc = sinks.metrics_document(metrics.core_metrics(scored), metrics.core_metrics(at_opt), opt,
                                 metrics.brier_score(scored, "y", "p"),
                                 bootstrap.bootstrap_ci(scored, "y", "pred", "p", n_iterations=1000))
    sinks.sink_metrics_json(spark, doc, out_json)
    sinks.save_threshold(spark, _p(version, "metadata.json"), t)  # the one that scoring uses
    sinks.save_threshold(spark, _p(model_dir, "metadata.json"), t)
    return doc


def score(spark: SparkSession, json_path: str, prof: Profile, model_dir: str, out: str | None = None) -> DataFrame:
    """Scores of JSON patients: one row each, with their id where they have one."""
    held = patients.json_columns(spark, json_path)
    missing = [c for c in prof.required if c not in held]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    res = score_rows(patients.scan_patients_json(spark, json_path, prof.schema()), prof, model_store.current(spark, model_dir))
    if out:
        res.write.mode("overwrite").parquet(out)
    return res


def score_rows(raw: DataFrame, prof: Profile, version: str) -> DataFrame:
    """Scores of typed patients by the saved version of a model."""
    spark = raw.sparkSession
    # patients are joined by a number of their own, as ids may be absent or repeat; written, so that it stays
    raw = materialize(raw.withColumn("_id", F.col(prof.key)).withColumn(prof.key, F.monotonically_increasing_id()), "patients")
    ids, df = raw.select(prof.key, "_id"), raw.drop("_id")
    x, names = prep_apply(df, PipelineModel.load(_p(version, "prep")))
    p = calibrated_probability(assemble(x, names), prof.key, version)
    t = sinks.load_threshold(spark, _p(version, "metadata.json"))
    j = df.select(prof.key).join(p, prof.key)
    gate = None
    if prof.gate:
        j = j.join(gate_flags(df, prof, version), prof.key)
        gate = F.col("flag")
    prob_name = "heart_disease_probability" if prof.name == "heart" else "ckd_probability"
    res = cascade.score_cascade(j, prof.key, [], F.col("p"), gate=gate, threshold=t, prob_name=prob_name)
    if not prof.gate:
        res = res.drop("anomaly_flagged")
    return ids.join(res, prof.key).drop(prof.key).withColumnRenamed("_id", prof.key)


def predict_single(spark: SparkSession, patient: dict, prof: Profile, model_dir: str) -> dict:
    """Score of one patient, given and returned as a dict; a lacking column raises."""
    missing = [c for c in prof.required if c not in patient]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    kinds = {f.name: f.dataType for f in prof.schema().fields}
    typed = {c: v if v is None else float(v) if isinstance(kinds[c], T.DoubleType) else str(v) if isinstance(kinds[c], T.StringType) else int(v)
             for c, v in patient.items() if c in kinds}
    rows = patients.rows_from_records(spark, typed, prof.schema())
    return score_rows(rows, prof, model_store.current(spark, model_dir)).first().asDict()


def score_stream(spark: SparkSession, source_dir: str, prof: Profile, model_dir: str, out: str, **options):
    """The saved cascade on a stream of JSON lines, with a commit log and a quarantine (``streaming.model_stream``). The
    version in use at the start scores the whole run."""
    version = model_store.current(spark, model_dir)
    return model_stream.score_stream_batches(spark, source_dir, prof.schema(), prof.required,
                                             lambda rows: score_rows(rows, prof, version), out, **options)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="riskframe-jobs")
    ap.add_argument("job", choices=["train", "evaluate", "score", "stream"])
    ap.add_argument("--profile", choices=sorted(PROFILES), default="heart")
    ap.add_argument("--data", required=True, help="CSV (train/evaluate), JSON (score) or a folder of JSON lines (stream)")
    ap.add_argument("--model-dir", required=True)
    ap.add_argument("--out", default=None)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"riskframe-{a.job}").getOrCreate()
    prof = PROFILES[a.profile]
    if a.job == "train":
        train(spark, a.data, prof, a.model_dir)
    elif a.job == "evaluate":
        print(json.dumps(evaluate(spark, a.data, prof, a.model_dir, a.out or _p(a.model_dir, "metrics"))))
    elif a.job == "stream":
        score_stream(spark, a.data, prof, a.model_dir, a.out or _p(a.model_dir, "stream"))
    else:
        score(spark, a.data, prof, a.model_dir, a.out).show(truncate=False)


if __name__ == "__main__":
    main()
