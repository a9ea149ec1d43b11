"""Parameter grids of the two training jobs, by model."""

from __future__ import annotations

import numpy as np

from riskframe.operators.models import param_grid_expand

# The value lists of each model's grid; their order decides ties.
HEART_GRIDS = {
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "p": [1, 2]},
    "decision_tree": {"criterion": ["gini", "entropy"], "max_depth": [3, 5, 7, 10, 15, None], "min_samples_split": [2, 5, 10, 20],
                      "min_samples_leaf": [1, 2, 4, 8], "max_features": [None, "sqrt", "log2"]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [6, 8, 12, None], "min_samples_split": [2, 5, 10],
                      "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"], "bootstrap": [True, False]},
    "naive_bayes": {"var_smoothing": np.logspace(0, -9, num=20).tolist()},
    "neural_network": {"hidden": [(32, 16), (64, 32), (100,)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001, 0.01],
                       "learning_rate": ["constant", "adaptive"]},
    "xgboost": {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2], "subsample": [0.8, 1.0]},
    "catboost": {"n_estimators": [100, 200], "max_depth": [4, 6], "learning_rate": [0.01, 0.1]},
}
KIDNEY_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
    "naive_bayes": {"var_smoothing": np.logspace(0, -11, num=50).tolist()},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11, 15]},
    "decision_tree": {"criterion": ["gini", "entropy"], "max_depth": [5, 10, 15, 20, None], "min_samples_split": [2, 5, 10],
                      "min_samples_leaf": [1, 2, 4]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [10, 20, 30, None], "max_features": ["sqrt", "log2"]},
    "xgboost": {"n_estimators": [100, 300, 500], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
    "lightgbm": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "num_leaves": [31]},
    "svm_rbf": {"C": [0.1, 1.0, 10.0, 50.0], "gamma": ["scale", "auto"], "kernel": ["rbf"]},
    "neural_network": {"hidden": [(100,), (100, 50), (128, 64, 32)], "alpha": [0.0001, 0.001, 0.01], "learning_rate_init": [0.001, 0.01]},
}
GRIDS = {"heart": HEART_GRIDS, "kidney": KIDNEY_GRIDS}


def points(profile: str, model: str) -> list[dict]:
    """The model's grid points in order; a point's place is its ``grid_id``."""
    return param_grid_expand(GRIDS[profile][model])
