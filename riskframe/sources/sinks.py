"""Sinks: metrics document (JSON), result tables (CSV), decision threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_THRESHOLD = 0.5


def metrics_document(core_default: DataFrame, core_optimal: DataFrame, threshold: DataFrame,
                     brier: DataFrame, ci: DataFrame) -> dict:
    """The nested evaluation document: optimal_threshold, brier_score,
    metrics_at_default_threshold{…}, metrics_at_optimal_threshold{…},
    bootstrap_confidence_intervals{recall,roc_auc,pr_auc}{mean,lower_95,upper_95}.
    Every input is a one-row (CI: three-row) aggregate, so assembling the
    document reads back a handful of numbers, never data rows."""
    fields = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "false_negatives",
              "false_positives"]
    d, o = core_default.first(), core_optimal.first()
    cis = {r["metric"]: {"mean": r["mean"], "lower_95": r["lower_95"], "upper_95": r["upper_95"]}
           for r in ci.collect()}
    return {"optimal_threshold": threshold.first()["threshold"], "brier_score": brier.first()["brier_score"],
            "metrics_at_default_threshold": {f: d[f] for f in fields},
            "metrics_at_optimal_threshold": {f: o[f] for f in fields},
            "bootstrap_confidence_intervals": {m: cis.get(m) for m in ("recall", "roc_auc", "pr_auc")}}


def sink_metrics_json(spark: SparkSession, doc: dict, path: str) -> DataFrame:
    """Write the document as one JSON object; returns it as a one-row DataFrame."""
    import json
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(doc)], 1))
    df.coalesce(1).write.mode("overwrite").json(path)
    return df


def sink_results_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_threshold(spark: SparkSession, path: str, threshold: float) -> None:
    """One JSON row, written by Spark to wherever ``path`` lies."""
    row = spark.createDataFrame([(float(threshold),)], "optimal_threshold double")
    row.coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark: SparkSession, path: str | None, default: float = DEFAULT_THRESHOLD) -> float:
    """``optimal_threshold`` from a metadata JSON; the default where there is no path, no such
    file or no such key. Anything else that goes wrong raises."""
    if not path or not path_exists(spark, path):
        return default
    df = spark.read.schema(T.StructType([T.StructField("optimal_threshold", T.DoubleType())])) \
              .option("multiLine", True).json(path)
    row = df.agg(F.coalesce(F.first("optimal_threshold", ignorenulls=True), F.lit(default)).alias("t")).first()
    return float(row["t"])
