"""Stratified train/test split and k folds, as pure functions of (seed, key).

Rows are ranked per class by ``(h(seed, key), key)``. A plain window
partitioned by the class would put half the table into one task, so the rank
is computed in two phases: the 32-bit hash is uniform, so its top bits give
``n_buckets`` order-preserving, evenly filled buckets; a window ranks rows
inside each ``(class, bucket)`` and a ``classes × n_buckets`` offset table
(bounded by the parameter; broadcast) shifts them to the global rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rng import H_RANGE, h

DEFAULT_BUCKETS = 4096


def stratified_rank(df: DataFrame, key: str, y: str, seed=42, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """df + ``_rank`` (1-based, per class, by hash order) + ``_class_n``."""
    hv = h(seed, key)
    d = df.withColumn("_h", hv).withColumn(
        "_hb", (F.col("_h") * F.lit(float(n_buckets)) / F.lit(H_RANGE)).cast("int"))
    inner = Window.partitionBy(y, "_hb").orderBy("_h", key)
    d = d.withColumn("_r_in", F.row_number().over(inner))
    counts = d.groupBy(y, "_hb").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(y).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(y, "_hb", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(Window.partitionBy(y)).alias("_class_n"))
    # one row per (class, bucket); Spark broadcasts it where its measured size allows
    d = d.join(offs, [y, "_hb"])
    return d.withColumn("_rank", F.col("_r_in") + F.col("_off")).drop("_h", "_hb", "_r_in", "_off")


def stratified_split(df: DataFrame, key: str, y: str, test: float = 0.2, seed=42,
                     n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """df + ``split`` ∈ {train, test}: per class the first round(test·n_y) rows
    in hash order are test. Disjoint, class ratio kept to ±1 row."""
    r = stratified_rank(df, key, y, seed, n_buckets)
    is_test = F.col("_rank") <= F.round(F.lit(float(test)) * F.col("_class_n"))
    return r.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_rank", "_class_n")


def stratified_kfold(df: DataFrame, key: str, y: str, k: int = 5, seed=42,
                     n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """df + ``fold`` = (rank − 1) mod k within each class."""
    r = stratified_rank(df, key, y, seed, n_buckets)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_class_n")
