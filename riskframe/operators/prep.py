"""Fit-on-train / apply-anywhere preprocessing as stat tables.

``fit_*`` returns a small DataFrame (one row per column, or per category);
``apply_*`` reads that table back — its size is bounded by the schema, not the
data — and applies it as literal column expressions, so applying never joins
or shuffles and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.quantiles import exact_quantiles


def _unpivot_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(rows))


# ------------------------------------------------------------------ mode impute

def fit_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n): most frequent non-NULL value; ties → smallest value.
    Counts are partial-aggregated per (column, value); the arg-max is a
    distributive ``min(struct(-n, value))``."""
    counts = (_unpivot_strings(df, cols).where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "value")).alias("b"))
    return best.select("column_name", F.col("b.value").alias("value"), (-F.col("b.neg_n")).alias("n"))


def apply_mode(df: DataFrame, stats: DataFrame) -> DataFrame:
    fill = {r["column_name"]: r["value"] for r in stats.collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


# ------------------------------------------------------------------ robust scale

def fit_robust(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, median, iqr) with linear-interpolated exact quantiles (NULL for a column without values)."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in cols])
    q = exact_quantiles(df.select(F.inline(rows)), "_x", [0.25, 0.5, 0.75], ["column_name"])
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(q, "column_name", "left").select(
        "column_name", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def apply_robust(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(x − median) / IQR; an IQR of 0 divides by 1."""
    out = {}
    for r in stats.collect():
        iqr = r["iqr"] if r["iqr"] not in (None, 0.0) else 1.0
        out[r["column_name"]] = (F.col(r["column_name"]) - F.lit(r["median"])) / F.lit(iqr)
    return df.withColumns(out)


# ------------------------------------------------------------------ standard scale

def fit_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, mean, sd_pop) — population standard deviation."""
    wide = df.agg(*[F.struct(F.avg(F.col(c)).alias("m"), F.stddev_pop(F.col(c)).alias("s")).alias(c)
                    for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["m"].alias("mean"),
                              F.col(c)["s"].alias("sd_pop")) for c in cols])
    return wide.select(F.inline(rows))


def apply_standard(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(x − mean) / sd; a zero sd divides by 1."""
    out = {}
    for r in stats.collect():
        sd = r["sd_pop"] if r["sd_pop"] not in (None, 0.0) else 1.0
        out[r["column_name"]] = (F.col(r["column_name"]) - F.lit(r["mean"])) / F.lit(sd)
    return df.withColumns(out)


# ------------------------------------------------------------------ one-hot

def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, pos): categories seen in training, sorted, pos 0-based."""
    cats = _unpivot_strings(df, cols).where(F.col("value").isNotNull()).distinct()
    return cats.withColumn("pos", F.row_number().over(Window.partitionBy("column_name").orderBy("value")) - 1)


def one_hot_names(stats: DataFrame) -> list[tuple[str, str, str]]:
    """[(column_name, value, output name)] in column order then category order."""
    rows = sorted(stats.collect(), key=lambda r: (r["column_name"], r["pos"]))
    return [(r["column_name"], r["value"], f"{r['column_name']}_{r['value']}") for r in rows]


def apply_one_hot(df: DataFrame, stats: DataFrame, keep_source: bool = False) -> DataFrame:
    """One 0/1 double column per learned category; unseen or NULL ⇒ all zeros."""
    names = one_hot_names(stats)
    out = df.withColumns({n: (F.col(c).cast("string") == F.lit(v)).cast("double") for c, v, n in names})
    out = out.fillna(0.0, subset=[n for _, _, n in names])
    if not keep_source:
        out = out.drop(*sorted({c for c, _, _ in names}))
    return out


def unseen_category_report(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_unseen): rows whose non-NULL category was not seen in training.
    A left-anti join of the unpivoted values against the category table, broadcast
    by Spark where its measured size allows."""
    vals = _unpivot_strings(df, cols).where(F.col("value").isNotNull())
    unseen = vals.join(stats.select("column_name", "value"), ["column_name", "value"], "left_anti")
    present = F.array(*[F.lit(c) for c in cols])
    base = df.sparkSession.range(1).select(F.explode(present).alias("column_name"))
    counts = unseen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unseen"))
    return base.join(counts, "column_name", "left").select("column_name", F.coalesce("n_unseen", F.lit(0)).alias("n_unseen"))
