"""Projections, predicates and clinical feature builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.scalar import safe_ratio

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType)
CATEGORICAL_TYPES = (T.StringType,)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def drop_columns_if_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def binarize_target(df: DataFrame, col: str = "num", out: str = "target") -> DataFrame:
    """Ordinal disease grade → 1 when > 0, else 0 (NULL stays NULL)."""
    return df.withColumn(out, (F.col(col) > 0).cast("int"))


def cast_target_int(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("int"))


def split_features_target(df: DataFrame, target: str, drop: Sequence[str] = (),
                          key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(X, y) as two projections of the same rows; the key rides along in both."""
    keep = [key] if key else []
    feats = [c for c in df.columns if c not in set(drop) | {target} and c != key]
    return df.select(*keep, *feats), df.select(*keep, target)


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def select_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, CATEGORICAL_TYPES) and f.name not in exclude]


def validate_required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Plan-time check; raises ValueError listing the missing names."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


HEART_DERIVED = ["max_hr_ratio", "bp_hr_index", "age_st_interaction"]
KIDNEY_DERIVED = ["pulse_pressure", "map", "bun_cr_ratio", "ca_p_product", "bmi_bp_interaction"]


def heart_features(df: DataFrame) -> DataFrame:
    """max_hr_ratio = thalch/((220−age)+1e-5); bp_hr_index = trestbps/(thalch+1e-5);
    age_st_interaction = age·oldpeak. Missing inputs raise (as the reference does)."""
    validate_required_columns(df, ["age", "thalch", "trestbps", "oldpeak"])
    return df.withColumns({
        "max_hr_ratio": safe_ratio(F.col("thalch"), F.lit(220.0) - F.col("age")),
        "bp_hr_index": safe_ratio(F.col("trestbps"), F.col("thalch")),
        "age_st_interaction": F.col("age") * F.col("oldpeak"),
    })


def kidney_features(df: DataFrame) -> DataFrame:
    """Five kidney features; each group is the constant 0 when an input column is absent."""
    have = set(df.columns)
    zero = F.lit(0.0)
    sys_, dia = F.col("bp_systolic"), F.col("bp_diastolic")
    bp = {"bp_systolic", "bp_diastolic"} <= have
    out = {
        "pulse_pressure": (sys_ - dia) if bp else zero,
        "map": ((sys_ + 2 * dia) / 3) if bp else zero,
        "bun_cr_ratio": (safe_ratio(F.col("blood_urea_nitrogen"), F.col("serum_creatinine"))
                         if {"blood_urea_nitrogen", "serum_creatinine"} <= have else zero),
        "ca_p_product": (F.col("calcium") * F.col("phosphorus")
                         if {"calcium", "phosphorus"} <= have else zero),
        "bmi_bp_interaction": (F.col("bmi") * sys_ if {"bmi", "bp_systolic"} <= have else zero),
    }
    return df.withColumns(out)


def custom_features(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The user hook: any DataFrame → DataFrame function."""
    return df.transform(fn)
