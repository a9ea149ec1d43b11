"""Grid searches whose points share their fits.

Folds are tables (train, valid) of prepared rows, resampled where the caller wishes, as ``search.fold_tables`` makes them
before it assembles vectors. Each search returns (grid_id, fold, recall), as ``search.grid_search_recall``
does, so ``search.grid_results_rank`` ranks it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.models import gaussian_nb_fit
from riskframe.operators.neighbors import knn_join

RESULT = "grid_id int, fold int, recall double"


def nb_search(folds: list[tuple[DataFrame, DataFrame]], y: str, cols: Sequence[str], grid: list[dict]) -> DataFrame:
    """Gaussian naive Bayes at every ``var_smoothing``: one grouped aggregate and one scan of the held-out rows a fold.

    A smoothing only adds to the variances, so all points come from one fit; their parameters (points of the grid x
    columns numbers) meet the rows in a broadcast. Rows with a null among ``cols`` are predicted as class 0."""
    cols = list(cols)
    spark, out = folds[0][0].sparkSession, None
    for fold, (train, valid) in enumerate(folds):
        fit = gaussian_nb_fit(train, y, cols, var_smoothing=0.0)
        wide = train.agg(F.greatest(*[F.var_pop(c) for c in cols]) if len(cols) > 1 else F.var_pop(cols[0])).first()[0] or 0.0
        rows = []
        for i, g in enumerate(grid):
            var = [[v + g["var_smoothing"] * wide for v in each] for each in fit["var"]]
            const = [math.log(p) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in each) for p, each in zip(fit["prior"], var)]
            rows.append((i, const[1] - const[0], *fit["mu"], *[[0.5 / v for v in each] for each in var]))
        table = spark.createDataFrame(rows, "grid_id int, _c double, _m0 array<double>, _m1 array<double>, _w0 array<double>, _w1 array<double>")
        margin = F.col("_c")
        for j, c in enumerate(cols):
            margin = margin + (F.pow(F.col(c) - F.col("_m0")[j], 2) * F.col("_w0")[j] - F.pow(F.col(c) - F.col("_m1")[j], 2) * F.col("_w1")[j])
        sick = valid.where(F.col(y) == 1).select(*cols)
        # every point scores every row: the small side is the grid itself
        scored = sick.withColumn("grid_id", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).join(F.broadcast(table), "grid_id")
        one = (scored.groupBy("grid_id").agg(F.avg(F.coalesce((margin > 0).cast("double"), F.lit(0.0))).alias("recall"))
               .select("grid_id", F.lit(fold).alias("fold"), "recall"))
        out = one if out is None else out.unionByName(one)
    return out


def knn_search(folds: list[tuple[DataFrame, DataFrame]], key: str, y: str, cols: Sequence[str], grid: list[dict]) -> DataFrame:
    """Nearest-neighbour votes at every ``n_neighbors``, ``weights`` and ``p``: one kNN join with the most neighbours a
    fold and metric; smaller counts take its first ranks, and both weights come from the same sums."""
    spark, rows = folds[0][0].sparkSession, []
    points = [(g["n_neighbors"], g.get("weights", "uniform"), g.get("p", 2)) for g in grid]
    for fold, (train, valid) in enumerate(folds):
        sick = valid.where(F.col(y) == 1)
        labels = train.select(F.col(key).alias("r_id"), F.col(y).cast("double").alias("_y"))
        for p in sorted({p for *_, p in points}):
            here = [(i, k, w) for i, (k, w, q) in enumerate(points) if q == p]
            near = knn_join(sick, train, key, key, cols, k=max(k for _, k, _ in here), metric="euclidean" if p == 2 else "manhattan")
            near = near.join(labels, "r_id").withColumn("_inv", F.when(F.col("dist") > 0, 1.0 / F.col("dist")))
            votes = {}
            for i, k, w in here:
                first = F.col("rank") <= k
                if w == "uniform":
                    votes[i] = F.avg(F.when(first, F.col("_y")))
                else:  # neighbours at distance zero vote alone
                    same = F.avg(F.when(first & (F.col("dist") == 0), F.col("_y")))
                    votes[i] = F.coalesce(same, F.sum(F.when(first, F.col("_inv") * F.col("_y"))) / F.sum(F.when(first, F.col("_inv"))))
            found = near.groupBy("q_id").agg(*[v.alias(f"v{i}") for i, v in votes.items()])
            hits = found.agg(*[F.sum((F.col(f"v{i}") > 0.5).cast("long")).alias(f"v{i}") for i in votes]).first()
            n = sick.count()
            rows += [(i, fold, (hits[f"v{i}"] or 0) / n if n else 0.0) for i in votes]
    return spark.createDataFrame(rows, RESULT)
