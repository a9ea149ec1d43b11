"""Data profiling aggregates: counts, describe, schema, shape, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.quantiles import long_columns, select_quantiles, written_values


def value_counts_with_null(df: DataFrame, col: str) -> DataFrame:
    """(value, n) including the NULL group."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Transposed describe: (feature, count, mean, std, min, p25, p50, p75, max).

    std is the sample std (ddof=1); quartiles are linear-interpolated exact
    quantiles by selection. The columns are read once and written narrow; moments
    and quartiles come from that table. A column without values has NULLs."""
    values = written_values(long_columns(df, cols, "feature"), "_x", ["feature"])
    quartiles = select_quantiles(values, [0.25, 0.5, 0.75], ["feature"])
    v = F.col("_v")
    moments = values.groupBy("feature").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                            F.min(v).alias("min"), F.max(v).alias("max"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(moments, "feature", "left").join(quartiles, "feature", "left").select(
        "feature", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def schema_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) per column, in schema order (``position``)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                              F.col(f"c{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.inline(rows))


def shape_report(df: DataFrame, split_col: str = "split", exclude: Sequence[str] = ()) -> DataFrame:
    """(split, n_rows, n_cols) — n_cols counts feature columns (excluding the split)."""
    n_cols = len([c for c in df.columns if c != split_col and c not in exclude])
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")) \
             .withColumn("n_cols", F.lit(n_cols))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every pair i < j, pairwise-complete (rows where both are
    present), NULL for a constant column instead of an error. One aggregate
    with streaming (numerically stable) moments, then a generator."""
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            xa, xb = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            k = f"{i}_{j}"
            aggs += [F.covar_samp(xa, xb).alias(f"cov{k}"), F.stddev_samp(xa).alias(f"sa{k}"),
                     F.stddev_samp(xb).alias(f"sb{k}")]
            pairs.append((a, b, k))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                              F.try_divide(F.col(f"cov{k}"), F.col(f"sa{k}") * F.col(f"sb{k}")).alias("r"))
                     for a, b, k in pairs])
    return wide.select(F.inline(rows))


def prune_correlated(corr: DataFrame, cols: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Columns to drop: the later column of every pair with |r| > threshold
    (strict upper triangle, no greedy re-check)."""
    return (corr.where(F.abs(F.col("r")) > F.lit(threshold))
            .select(F.col("feature_b").alias("column")).distinct())


def group_profile(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per group, transposed: (feature, group, mean)."""
    wide = df.groupBy(group).agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([group], list(cols), "feature", "mean")


def transpose_table(long: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, value) → one row per ``row`` with a column per ``col`` value."""
    return long.groupBy(row).pivot(col).agg(F.first(value))
