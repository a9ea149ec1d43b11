"""SMOTE oversampling (Chawla et al. 2002) with hashed, partition-free randomness.

The minority class is grown to the majority count. Minority row r (rank by
hash order) is the base of ``quota_r`` synthetic rows, quotas differing by at
most one, so work is spread evenly and no single base row is hot. Synthetic
row j takes neighbour #(h(seed, 'nn|j') mod k)+1 among the base's k nearest
minority rows (exact grid kNN join) and λ = u(seed, 'lam|j'):
x_syn = x + λ·(x_nn − x).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rng import h, u01
from riskframe.operators.metric_index import NEAR_ROWS
from riskframe.operators.neighbors import knn_join
from riskframe.operators.split import stratified_rank


def smote(df: DataFrame, key: str, y: str, cols: Sequence[str], k: int = 5, seed: int = 42,
          cell_rows: int = NEAR_ROWS) -> DataFrame:
    """df ∪ synthetic minority rows: (key string, y, cols…, synthetic boolean)."""
    cols = list(cols)
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    base = df.select(F.col(key).cast("string").alias(key), F.col(y), *[F.col(c).cast("double").alias(c) for c in cols],
                     F.lit(False).alias("synthetic"))
    if len(counts) < 2:
        return base
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_syn = n_maj - n_min
    if n_syn == 0 or n_min < 2:
        return base
    mino = df.where(F.col(y) == F.lit(minority)).select(key, y, *cols)
    ranked = stratified_rank(mino, key, y, seed).select(key, *cols, (F.col("_rank") - 1).alias("_r"))
    nbrs = knn_join(mino, mino, key, key, cols, k=k, exclude_self=True, cell_rows=cell_rows)
    k_eff = min(k, n_min - 1)
    q, rem = divmod(n_syn, n_min)
    quota = F.lit(q) + (F.col("_r") < F.lit(rem)).cast("int")
    jobs = (ranked.where(quota > 0)
            .select("*", F.explode(F.sequence(F.lit(0), quota - 1)).alias("_copy"))
            .withColumn("_j", F.col("_copy") * F.lit(n_min) + F.col("_r")))
    jobs = jobs.withColumn("_nn", (h(seed, F.concat(F.lit("nn|"), F.col("_j").cast("string"))) % k_eff + 1).cast("int")) \
               .withColumn("_lam", u01(seed, F.concat(F.lit("lam|"), F.col("_j").cast("string"))))
    pick = jobs.join(nbrs.select(F.col("q_id").alias(key), F.col("rank").alias("_nn"), F.col("r_id").alias("_nid")),
                     [key, "_nn"])
    other = mino.select(F.col(key).alias("_nid"), *[F.col(c).cast("double").alias(f"_o_{c}") for c in cols])
    syn = pick.join(other, "_nid").select(
        F.concat(F.lit("syn-"), F.col("_j").cast("string")).alias(key), F.lit(minority).cast(df.schema[y].dataType).alias(y),
        *[(F.col(c) + F.col("_lam") * (F.col(f"_o_{c}") - F.col(c))).alias(c) for c in cols],
        F.lit(True).alias("synthetic"))
    return base.unionByName(syn)
