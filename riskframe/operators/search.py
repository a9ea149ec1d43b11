"""Model search, comparison and calibration around MLlib estimators.

* Preprocessing and SMOTE run once per fold (cached), not once per grid point
  × fold: 5 preparations instead of 5 × |grid|.
* Grid points × folds are submitted from a small driver thread pool; each fit
  is a distributed MLlib job.
* Every scored set is one long table ``(model, key, y, pred, p)`` so all
  metrics for all models come from one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.isotonic import IsotonicFit
from riskframe.operators.split import stratified_kfold
from riskframe.session import materialize


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def fit_sigmoid(folds: list[tuple[DataFrame, DataFrame]], make: Callable[[], object], y: str) -> tuple[float, float]:
    """(slope, shift) of the sigmoid that maps margins to probabilities, fitted on the margins of
    held-out folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    held = None
    for tr, va in folds:
        m = make().setLabelCol(y).setFeaturesCol("features").fit(tr)
        one = m.transform(va).select(F.col(y).cast("double").alias("y"), array_to_vector(
            F.array(vector_to_array("rawPrediction")[1])).alias("margin"))
        held = one if held is None else held.unionByName(one)
    fit = LogisticRegression(featuresCol="margin", labelCol="y", maxIter=100).fit(materialize(held, "margins"))
    return float(fit.coefficients[0]), float(fit.intercept)


def score_model(model, df: DataFrame, key: str, y: str | None = None,
                sigmoid: tuple[float, float] | None = None) -> DataFrame:
    """(key, y?, pred, p): hard label and class-1 probability."""
    from pyspark.ml.functions import vector_to_array
    t = model.transform(df)
    cols = [key] + ([y] if y else [])
    if "probability" in t.columns:
        p = vector_to_array("probability")[1]
    else:  # margin-only models (LinearSVC): the sigmoid fitted with fit_sigmoid
        if sigmoid is None:
            raise ValueError("a model without probabilities needs a fitted sigmoid")
        slope, shift = sigmoid
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * vector_to_array("rawPrediction")[1] + F.lit(shift))))
    return t.select(*cols, F.col("prediction").cast("int").alias("pred"), p.alias("p"))


def fold_tables(df: DataFrame, key: str, y: str, cols: Sequence[str], k: int = 5, seed: int = 42,
                resample: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """[(train_vec, valid_vec)] per fold, materialised once in the checkpoint folder."""
    folds = materialize(stratified_kfold(df, key, y, k, seed), "folds")
    out = []
    for f in range(k):
        tr = folds.where(F.col("fold") != f).drop("fold")
        va = folds.where(F.col("fold") == f).drop("fold")
        if resample is not None:
            tr = resample(tr)
        tr_v = materialize(assemble(tr.withColumn(y, F.col(y).cast("double")), cols).select(key, y, "features"), "fold-tr")
        va_v = materialize(assemble(va, cols).select(key, y, "features"), "fold-va")
        out.append((tr_v, va_v))
    return out


def grid_search_recall(folds: list[tuple[DataFrame, DataFrame]], key: str, y: str,
                       make: Callable[[dict], object], grid: list[dict], threads: int = 4
                       ) -> tuple[DataFrame, dict]:
    """Exhaustive search by mean held-out recall; the first (lowest grid id)
    best point wins. Returns ((grid_id, fold, recall) table, best params)."""
    def run(task):
        gid, fid = task
        tr, va = folds[fid]
        est = make(grid[gid]).setLabelCol(y).setFeaturesCol("features")
        model = est.fit(tr)
        s = score_model(model, va, key, y)
        r = s.agg(F.count_if((F.col(y) == 1) & (F.col("pred") == 1)).alias("tp"),
                  F.count_if(F.col(y) == 1).alias("pos")).first()
        return gid, fid, (r["tp"] / r["pos"]) if r["pos"] else 0.0

    tasks = [(g, f) for g in range(len(grid)) for f in range(len(folds))]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = list(pool.map(run, tasks))
    spark = folds[0][0].sparkSession
    res = spark.createDataFrame(rows, "grid_id int, fold int, recall double")
    best = grid_results_rank(res).first()
    return res, grid[best["grid_id"]]


def grid_results_rank(results: DataFrame) -> DataFrame:
    """(grid_id, mean_recall) best first; ties → lowest grid id."""
    return (results.groupBy("grid_id").agg(F.avg("recall").alias("mean_recall"))
            .orderBy(F.col("mean_recall").desc(), F.col("grid_id").asc()))


def calibrate_isotonic(df: DataFrame, key: str, y: str, cols: Sequence[str], make: Callable[[], object],
                       score_on: DataFrame, cv: int = 3, seed: int = 42) -> DataFrame:
    """Isotonic calibration with ``cv`` stratified folds: per fold the model is
    refit on the other folds and an isotonic map is fit on the held-out scores;
    the calibrated probability is the mean of the ``cv`` calibrated outputs.
    Returns (key, p_raw, p) on ``score_on``; p_raw is from the model fitted on all rows of ``df``."""
    folds = fold_tables(df, key, y, cols, cv, seed)
    target = assemble(score_on, cols)
    outs = []
    for i, (tr, va) in enumerate(folds):
        model = make().setLabelCol(y).setFeaturesCol("features").fit(tr)
        held = score_model(model, va, key, y)
        cal = IsotonicFit(held, y, "p").apply(score_model(model, target, key), "p", f"cal{i}").select(key, f"cal{i}")
        outs.append(cal)
    whole = assemble(df.withColumn(y, F.col(y).cast("double")), cols).select(key, y, "features")
    raw = make().setLabelCol(y).setFeaturesCol("features").fit(whole)
    j = score_model(raw, target, key).select(key, F.col("p").alias("p_raw"))
    for o in outs:
        j = j.join(o, key)
    mean = sum((F.col(f"cal{i}") for i in range(1, cv)), F.col("cal0")) / F.lit(float(cv))
    return j.select(key, "p_raw", mean.alias("p"))
