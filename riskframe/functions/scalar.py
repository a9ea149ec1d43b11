"""Scalar column functions (all JVM-side built-ins, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Risk bands (independent of the decision threshold) and labels.
LOW_RISK_BELOW = 0.20
MEDIUM_RISK_BELOW = 0.50
LOW_RISK = "Low Risk"
MEDIUM_RISK = "Medium Risk"
HIGH_RISK = "High Risk"
MANUAL_REVIEW = "Anomaly - Manual Review"
EPS = 1e-5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def safe_ratio(num, den, eps: float = EPS) -> Column:
    """num / (den + eps); NULL in ⇒ NULL out; never raises under ANSI."""
    return F.try_divide(_c(num), _c(den) + F.lit(eps))


def ratio_or_zero(num, den) -> Column:
    """num / den, or 0 when den is 0 or NULL."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den)), F.lit(0.0))


def risk_band(p) -> Column:
    pc = _c(p)
    return (F.when(pc < LOW_RISK_BELOW, F.lit(LOW_RISK))
            .when(pc < MEDIUM_RISK_BELOW, F.lit(MEDIUM_RISK))
            .when(pc.isNotNull(), F.lit(HIGH_RISK)))


def label_names(y, names: tuple[str, str]) -> Column:
    yc = _c(y)
    return F.when(yc == 0, F.lit(names[0])).when(yc == 1, F.lit(names[1]))


def normalize_anomaly_flag(flag) -> Column:
    """Detector convention 1 = outlier / 0 = inlier → −1 = anomaly / +1 = normal."""
    fc = _c(flag)
    return F.when(fc == 1, F.lit(-1)).when(fc == 0, F.lit(1))


def strip_feature_prefix(name) -> Column:
    """Text after the last ``__`` (transformer-prefixed feature names)."""
    return F.element_at(F.split(_c(name), "__"), -1)


def humanize_feature(name) -> Column:
    """``cp_typical_angina`` → ``Cp Typical Angina`` (``initcap`` capitalises
    after spaces only, so ``non-anginal`` stays ``Non-anginal``)."""
    return F.initcap(F.regexp_replace(_c(name), "_", " "))


def bool_to_label(b) -> Column:
    """Boolean category → ``True`` / ``False`` label."""
    return F.initcap(_c(b).cast("string"))


_FIXED = __import__("re").compile(r"^%(\+?)\.(\d+)f(%%)?$")


def fixed(value, decimals: int, sign: bool = False, percent: bool = False) -> Column:
    """Fixed-point text rounded like printf / Python: half-even on the exact
    binary value (``format_number``; ``format_string`` would round the shortest
    decimal text half-up and turn 0.75955 into 0.7596)."""
    v = _c(value)
    txt = F.regexp_replace(F.format_number(v, decimals), ",", "")
    if sign:
        txt = F.when(v >= 0, F.concat(F.lit("+"), txt)).otherwise(txt)
    if percent:
        txt = F.concat(txt, F.lit("%"))
    return txt


def fmt(value, pattern: str) -> Column:
    """printf-style formatting of one number: ``'%.4f'``, ``'%.2f%%'``, ``'%+.2f'``."""
    m = _FIXED.match(pattern)
    if not m:
        return F.format_string(pattern, _c(value))
    return fixed(value, int(m.group(2)), sign=bool(m.group(1)), percent=bool(m.group(3)))


def log_grid(spark: SparkSession, n: int, low_exp: float, high_exp: float = 0.0) -> DataFrame:
    """n log-spaced points from 10^high_exp down to 10^low_exp (e.g. var_smoothing grids)."""
    step = (high_exp - low_exp) / (n - 1)
    return spark.range(n).select(F.col("id").alias("i"),
                                 F.pow(F.lit(10.0), F.lit(high_exp) - F.col("id") * F.lit(step)).alias("value"))
