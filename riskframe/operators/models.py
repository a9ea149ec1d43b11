"""Supervised estimators.

* ``gaussian_nb``   exact Gaussian naive Bayes with var_smoothing, from one
                    grouped aggregate; scoring is a column expression.
* ``knn_classifier`` vote of the k nearest training rows (grid kNN join).
* ``isotonic_fit``  pool-adjacent-violators on per-score aggregates (MLlib).
* MLlib presets for logistic regression, trees, forests, boosted trees (three
  roles), MLP and an RBF-kernel SVM approximated with random Fourier features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.metric_index import NEAR_ROWS


# ------------------------------------------------------------------ Gaussian naive Bayes

def gaussian_nb_fit(df: DataFrame, y: str, cols: Sequence[str], var_smoothing: float = 1e-9) -> dict:
    """Class priors, per-class means and population variances (+ ε = var_smoothing ·
    largest feature variance). Two aggregates; the result has classes × features numbers."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"),
                            *[F.avg(c).alias(f"mu_{c}") for c in cols],
                            *[F.var_pop(c).alias(f"var_{c}") for c in cols]).collect()
    overall = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    eps = var_smoothing * max(float(overall[c] or 0.0) for c in cols)
    n = sum(r["_n"] for r in per)
    classes = sorted(per, key=lambda r: r[y])
    return {"classes": [r[y] for r in classes], "eps": eps,
            "prior": [r["_n"] / n for r in classes],
            "mu": [[float(r[f"mu_{c}"]) for c in cols] for r in classes],
            "var": [[float(r[f"var_{c}"]) + eps for c in cols] for r in classes], "cols": list(cols)}


def _nb_term(model: dict, i: int, j: int, x: Column) -> Column:
    var, mu = model["var"][i][j], model["mu"][i][j]
    return F.lit(-0.5 * math.log(2.0 * math.pi * var)) - (x - F.lit(mu)) * (x - F.lit(mu)) / F.lit(2.0 * var)


def _nb_loglik(model: dict, i: int, x: dict | None = None) -> Column:
    cols = model["cols"]
    x = x or {c: F.col(c) for c in cols}
    e = F.lit(math.log(model["prior"][i]))
    for j, c in enumerate(cols):
        e = e + _nb_term(model, i, j, x[c])
    return e


def gaussian_nb_proba(model: dict, x: dict | None = None) -> Column:
    """P(class = last class) for a binary model: 1 / (1 + exp(ll0 − ll1)).
    ``x`` optionally maps feature names to replacement columns."""
    l0, l1 = _nb_loglik(model, 0, x), _nb_loglik(model, 1, x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))


def gaussian_nb_logodds_terms(model: dict) -> dict[str, Column]:
    """Per-feature additive terms of the log-odds log P(1|x) − log P(0|x)
    (the prior ratio is the constant): exact inputs for ``additive_shap``."""
    return {c: _nb_term(model, 1, j, F.col(c)) - _nb_term(model, 0, j, F.col(c))
            for j, c in enumerate(model["cols"])}


# ------------------------------------------------------------------ kNN classifier

def knn_classifier(train: DataFrame, test: DataFrame, key: str, y: str, cols: Sequence[str], k: int = 5,
                   weights: str = "uniform", p: int = 2, cell_rows: int = NEAR_ROWS) -> DataFrame:
    """(key, proba, pred): share of class 1 among the k nearest training rows
    (``weights='distance'`` weighs by 1/d; exact matches then vote alone)."""
    from riskframe.operators.neighbors import knn_join
    metric = "euclidean" if p == 2 else "manhattan"
    nb = knn_join(test, train, key, key, cols, k=k, metric=metric, cell_rows=cell_rows)
    lab = train.select(F.col(key).alias("r_id"), F.col(y).alias("_y"))
    j = nb.join(lab, "r_id")
    if weights == "distance":
        has_zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("q_id"))
        j = j.withColumn("_zero", has_zero)
        wgt = F.when(F.col("_zero") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        wgt = F.lit(1.0)
    out = j.groupBy("q_id").agg((F.sum(wgt * F.col("_y")) / F.sum(wgt)).alias("proba"))
    return out.select(F.col("q_id").alias(key), "proba", (F.col("proba") > 0.5).cast("int").alias("pred"))


# ------------------------------------------------------------------ MLlib presets

def logistic(c: float = 1.0, penalty: str = "l2", n: int = 1, max_iter: int = 2000):
    """C-parameterised logistic regression: regParam = 1/(C·n), l1 ⇒ elasticNet 1."""
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(regParam=1.0 / (c * max(n, 1)), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, maxIter=max_iter)


def decision_tree(criterion: str = "gini", max_depth: int | None = None, min_samples_leaf: int = 1, seed: int = 42):
    from pyspark.ml.classification import DecisionTreeClassifier
    return DecisionTreeClassifier(impurity=criterion, maxDepth=30 if max_depth is None else max_depth,
                                  minInstancesPerNode=min_samples_leaf, seed=seed)


def random_forest(n_estimators: int = 100, max_depth: int | None = None, max_features: str = "sqrt",
                  bootstrap: bool = True, seed: int = 42):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth,
                                  featureSubsetStrategy=max_features, bootstrap=bootstrap, seed=seed)


def boosted_trees(role: str = "xgboost", n_estimators: int = 100, max_depth: int | None = None,
                  learning_rate: float = 0.1, subsample: float = 1.0, seed: int = 42):
    """GBT in the three booster roles: xgboost (depth 3 default), lightgbm (depth 5 ≈ 31 leaves),
    catboost (depth 6)."""
    from pyspark.ml.classification import GBTClassifier
    depth = max_depth or {"xgboost": 3, "lightgbm": 5, "catboost": 6}[role]
    return GBTClassifier(maxIter=n_estimators, maxDepth=depth, stepSize=learning_rate,
                         subsamplingRate=subsample, seed=seed)


def mlp(n_features: int, hidden: Sequence[int] = (64,), max_iter: int = 1000, seed: int = 42):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed)


def random_fourier_features(df: DataFrame, cols: Sequence[str], gamma: float, n_components: int = 100,
                            seed: int = 42, prefix: str = "rff") -> DataFrame:
    """z(x) = sqrt(2/D)·cos(W·x + b), W ~ N(0, 2γ), b ~ U(0, 2π) (Rahimi & Recht
    2007): RBF-kernel features as plain column expressions."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, len(cols)))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    out = {}
    for i in range(n_components):
        lin = F.lit(float(b[i]))
        for j, c in enumerate(cols):
            lin = lin + F.col(c) * F.lit(float(w[i, j]))
        out[f"{prefix}{i}"] = F.lit(scale) * F.cos(lin)
    return df.withColumns(out)


def gamma_scale(df: DataFrame, cols: Sequence[str]) -> float:
    """gamma='scale' = 1 / (d · Var(X)) over all feature values."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    var = long.agg(F.var_pop("v")).first()[0] or 1.0
    return 1.0 / (len(cols) * var)


# ------------------------------------------------------------------ parameter grids

def param_grid_expand(grid: dict) -> list[dict]:
    """Cartesian product of the value lists in declaration order (the order fixes
    the first-best tie-break)."""
    import itertools
    names = list(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]
