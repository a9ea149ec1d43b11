"""Two-stage scoring: anomaly gate, then a calibrated classifier with fixed risk bands.

The plan is narrow (no shuffle): validate → engineer → gate flag → score →
threshold → band, so the same function serves batch tables and file streams.
Rejected rows keep their key and get NULL probability / prediction and the
manual-review band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import MANUAL_REVIEW, risk_band
from riskframe.operators.features import validate_required_columns

DEFAULT_THRESHOLD = 0.5


def score_cascade(patients: DataFrame, key: str, required: Sequence[str],
                  probability: Callable[[DataFrame], Column] | Column,
                  gate: Callable[[DataFrame], Column] | Column | None = None,
                  threshold: float | None = None,
                  engineer: Callable[[DataFrame], DataFrame] | None = None,
                  prob_name: str = "probability") -> DataFrame:
    """(key, anomaly_flagged, <prob_name>, prediction, risk_level).

    ``gate`` yields the −1/+1 anomaly flag (None ⇒ no gate); ``probability``
    the class-1 probability; both are column expressions (fitted models
    compiled to expressions or UDF-free transforms)."""
    df = validate_required_columns(patients, required)
    if engineer is not None:
        df = engineer(df)
    t = DEFAULT_THRESHOLD if threshold is None else float(threshold)
    flag = F.lit(1) if gate is None else (gate(df) if callable(gate) else gate)
    prob = probability(df) if callable(probability) else probability
    flagged = flag == -1
    p = F.when(~flagged, prob)
    return df.select(
        key, flagged.alias("anomaly_flagged"), p.alias(prob_name),
        F.when(~flagged, (prob >= F.lit(t)).cast("int")).alias("prediction"),
        F.when(flagged, F.lit(MANUAL_REVIEW)).otherwise(risk_band(prob)).alias("risk_level"))


def score_direct(patients: DataFrame, key: str, required: Sequence[str], probability,
                 threshold: float | None = None, engineer=None, prob_name: str = "probability") -> DataFrame:
    """No gate (kidney src path): (key, <prob_name>, prediction, risk_level)."""
    out = score_cascade(patients, key, required, probability, None, threshold, engineer, prob_name)
    return out.drop("anomaly_flagged")


def merge_gate_scores(all_rows: DataFrame, survivors_scored: DataFrame, key: str, flag: DataFrame) -> DataFrame:
    """When survivors were scored by a separate job: put their scores back on all
    rows by key (left join), rejected rows marked for manual review."""
    j = all_rows.select(key).join(flag.select(key, "flag"), key, "left").join(survivors_scored, key, "left")
    flagged = F.col("flag") == -1
    return j.select(key, flagged.alias("anomaly_flagged"),
                    F.when(~flagged, F.col("probability")).alias("probability"),
                    F.when(~flagged, F.col("prediction")).alias("prediction"),
                    F.when(flagged, F.lit(MANUAL_REVIEW)).otherwise(F.col("risk_level")).alias("risk_level"))


def explain_cascade(scored: DataFrame, explanations: DataFrame, key: str) -> DataFrame:
    """Scored survivors with their top-factor text; rejected rows excluded."""
    return scored.where(~F.col("anomaly_flagged")).join(explanations, key, "left")
