"""Disease profiles: column sets, target rule, derived features, gate, model role."""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.operators import features


@dataclass(frozen=True)
class Profile:
    name: str
    key: str
    target: str
    binarize: bool                     # target > 0 ⇒ 1 (ordinal grade) vs. cast to int
    numeric: list[str]                 # raw numeric inputs
    categorical: list[str]
    derived: list[str]
    engineer: Callable[[DataFrame], DataFrame]
    drop: list[str] = field(default_factory=list)
    booster_role: str = "xgboost"
    gate: bool = False
    boolean: list[str] = field(default_factory=list)  # categorical columns stored as booleans
    resample: bool = True              # training folds get synthetic minority rows

    @property
    def features_numeric(self) -> list[str]:
        return self.numeric + self.derived

    @property
    def required(self) -> list[str]:
        return self.numeric + self.categorical

    def schema(self) -> T.StructType:
        fields = [T.StructField(self.key, T.LongType())]
        fields += [T.StructField(c, T.DoubleType()) for c in self.numeric]
        fields += [T.StructField(c, T.StringType()) for c in self.categorical]
        fields += [T.StructField(c, T.StringType()) for c in self.drop]
        fields += [T.StructField(self.target, T.DoubleType())]
        return T.StructType(fields)


# The clinical column sets of the two profiles.
HEART = Profile(
    name="heart", key="id", target="num", binarize=True,
    numeric=["age", "trestbps", "chol", "thalch", "oldpeak", "ca"],
    categorical=["sex", "dataset", "cp", "fbs", "restecg", "exang", "slope", "thal"],
    derived=list(features.HEART_DERIVED), engineer=features.heart_features,
    booster_role="catboost", gate=True, boolean=["fbs", "exang"])

KIDNEY = Profile(
    name="kidney", key="participant_id", target="ckd_present", binarize=False,
    numeric=["age", "education_level", "poverty_income_ratio", "bmi", "height_cm", "bp_systolic", "bp_diastolic",
             "serum_creatinine", "blood_urea_nitrogen", "albumin_serum", "phosphorus", "bicarbonate", "calcium",
             "uric_acid", "urine_creatinine", "urine_albumin", "albumin_creatinine_ratio", "diabetes_diagnosed",
             "insulin_use", "diabetes_pills", "ever_smoked", "current_smoker", "egfr"],
    categorical=["gender", "ethnicity"],
    derived=list(features.KIDNEY_DERIVED), engineer=features.kidney_features,
    drop=["weight_kg", "ckd_stage"], booster_role="lightgbm", gate=False)

PROFILES = {"heart": HEART, "kidney": KIDNEY}
