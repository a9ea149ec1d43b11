"""Registered queries: name → (spark, sf_dir) → DataFrame.

Every query reads the driver tables through the stand-in views of
``riskframe.sources.standins`` and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import curves, metrics
from riskframe.plans.tidy import tidy
from riskframe.sources import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def _scored(spark, sf_dir, with_pred=True):
    s = standins.scored(spark, sf_dir)
    return s.withColumn("pred", metrics.apply_threshold("p", 0.5)) if with_pred else s


# --------------------------------------------------------------------------- metrics over `scored`

@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), "y", "pred", by=["m"])


@register("core_metrics")
def q_core_metrics(spark, sf_dir):
    return metrics.core_metrics(_scored(spark, sf_dir), "y", "pred", "p", by=["m"])


@register("pr_curve")
def q_pr_curve(spark, sf_dir):
    return curves.pr_curve(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    return curves.roc_curve(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return curves.roc_auc(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("average_precision")
def q_average_precision(spark, sf_dir):
    return curves.average_precision(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("cost_optimal_threshold")
def q_cost_optimal_threshold(spark, sf_dir):
    return curves.cost_optimal_threshold(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("threshold_simulation")
def q_threshold_simulation(spark, sf_dir):
    return metrics.threshold_simulation(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("threshold_confusions")
def q_threshold_confusions(spark, sf_dir):
    return metrics.threshold_confusions(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("brier_score")
def q_brier_score(spark, sf_dir):
    return metrics.brier_score(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("calibration_curve")
def q_calibration_curve(spark, sf_dir):
    return metrics.calibration_curve(_scored(spark, sf_dir, False), "y", "p", by=["m"])


@register("classification_report")
def q_classification_report(spark, sf_dir):
    return metrics.classification_report(_scored(spark, sf_dir), "y", "pred", by=["m"])


def _comparison(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), F.col("m")))
    return metrics.compare_models(s, "model", "y", "pred", "p")


@register("compare_models")
def q_compare_models(spark, sf_dir):
    return _comparison(spark, sf_dir)


@register("rank_models")
def q_rank_models(spark, sf_dir):
    return metrics.rank_models(_comparison(spark, sf_dir)).select("model", "recall", "precision")


@register("melt_metrics")
def q_melt_metrics(spark, sf_dir):
    return metrics.melt_metrics(_comparison(spark, sf_dir))


# --------------------------------------------------------------------------- `obs`: targets, splits, profiling

from riskframe.functions import scalar  # noqa: E402
from riskframe.session import materialize  # noqa: E402
from riskframe.operators import features, prep, profile, split  # noqa: E402

OBS_NUM = standins.OBS_NUMERIC
OBS_CAT = standins.OBS_CATEGORICAL


def _labelled(spark, sf_dir):
    o = features.drop_null_target(standins.obs(spark, sf_dir), "num")
    return features.binarize_target(o, "num", "y")


def _split(spark, sf_dir):
    # fit-then-apply queries read the split table twice: write it once
    return materialize(split.stratified_split(_labelled(spark, sf_dir), "id", "y", test=0.2, seed=42), "obs-split")


def _train(spark, sf_dir):
    return _split(spark, sf_dir).where(F.col("split") == "train")


@register("value_counts_with_null")
def q_value_counts_with_null(spark, sf_dir):
    return profile.value_counts_with_null(standins.obs(spark, sf_dir), "num")


@register("binarize_target")
def q_binarize_target(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "num", "y")


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "y", "split")


@register("stratified_kfold")
def q_stratified_kfold(spark, sf_dir):
    return split.stratified_kfold(_labelled(spark, sf_dir), "id", "y", k=5, seed=42).select("id", "y", "fold")


@register("shape_report")
def q_shape_report(spark, sf_dir):
    s = _split(spark, sf_dir)
    x, _ = features.split_features_target(s, "y", drop=["num", "split"], key="id")
    return profile.shape_report(s.select("split", *[c for c in x.columns if c != "id"]), "split")


@register("describe_numeric")
def q_describe_numeric(spark, sf_dir):
    return profile.describe_numeric(standins.obs(spark, sf_dir), OBS_NUM)


@register("schema_profile")
def q_schema_profile(spark, sf_dir):
    return profile.schema_profile(standins.obs(spark, sf_dir))


@register("select_numeric")
def q_select_numeric(spark, sf_dir):
    o = standins.obs(spark, sf_dir)
    num = features.select_numeric(o, exclude=["id"])
    return o.select("id", *num)


@register("correlation_matrix")
def q_correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(standins.obs(spark, sf_dir), OBS_NUM)


@register("prune_correlated")
def q_prune_correlated(spark, sf_dir):
    corr = profile.correlation_matrix(standins.obs(spark, sf_dir), OBS_NUM)
    return profile.prune_correlated(corr, OBS_NUM, threshold=0.85)


@register("heart_features")
def q_heart_features(spark, sf_dir):
    return features.heart_features(standins.heart_obs(spark, sf_dir)).select("id", *features.HEART_DERIVED)


@register("risk_band")
def q_risk_band(spark, sf_dir):
    s = standins.scored(spark, sf_dir)
    return (s.withColumn("risk_level", scalar.risk_band("p"))
            .groupBy("m", "risk_level").agg(F.count(F.lit(1)).alias("n")))


@register("label_names")
def q_label_names(spark, sf_dir):
    lab = _labelled(spark, sf_dir).withColumn("label", scalar.label_names("y", ("Healthy", "Disease")))
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("fit_mode")
def q_fit_mode(spark, sf_dir):
    return prep.fit_mode(_train(spark, sf_dir), OBS_CAT)


@register("fit_robust")
def q_fit_robust(spark, sf_dir):
    return prep.fit_robust(_train(spark, sf_dir), OBS_NUM)


@register("fit_standard")
def q_fit_standard(spark, sf_dir):
    return prep.fit_standard(_train(spark, sf_dir), OBS_NUM)


@register("robust_scale")
def q_robust_scale(spark, sf_dir):
    s = _split(spark, sf_dir)
    stats = prep.fit_robust(s.where(F.col("split") == "train"), OBS_NUM)
    return prep.apply_robust(s, stats).select("id", *OBS_NUM)


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    s = _split(spark, sf_dir)
    stats = prep.fit_standard(s.where(F.col("split") == "train"), OBS_NUM)
    return prep.apply_standard(s, stats).select("id", *OBS_NUM)


@register("fit_one_hot")
def q_fit_one_hot(spark, sf_dir):
    return prep.fit_one_hot(_train(spark, sf_dir), OBS_CAT)


@register("one_hot")
def q_one_hot(spark, sf_dir):
    """Sparse view of the encoded block: (id, feature) for every 1.0 cell."""
    s = _split(spark, sf_dir)
    stats = prep.fit_one_hot(s.where(F.col("split") == "train"), OBS_CAT)
    names = [n for _, _, n in prep.one_hot_names(stats)]
    wide = prep.apply_one_hot(s.select("id", *OBS_CAT), stats)
    long = wide.unpivot(["id"], names, "feature", "value")
    return long.where(F.col("value") == 1.0).select("id", "feature")


@register("unseen_category_report")
def q_unseen_category_report(spark, sf_dir):
    s = _split(spark, sf_dir)
    stats = prep.fit_one_hot(s.where(F.col("split") == "train"), OBS_CAT)
    return prep.unseen_category_report(s.where(F.col("split") == "test"), stats, OBS_CAT)


@register("mode_impute")
def q_mode_impute(spark, sf_dir):
    s = _split(spark, sf_dir)
    stats = prep.fit_mode(s.where(F.col("split") == "train"), OBS_CAT)
    return prep.apply_mode(s, stats).select("id", *OBS_CAT)


# --------------------------------------------------------------------------- neighbours

from riskframe.operators import neighbors  # noqa: E402

HEART_NUM = standins.HEART_NUMERIC


def _heart_split(spark, sf_dir):
    h = features.binarize_target(features.drop_null_target(standins.heart_obs(spark, sf_dir), "num"), "num", "y")
    return split.stratified_split(h, "id", "y", test=0.2, seed=42)


@register("knn_impute")
def q_knn_impute(spark, sf_dir):
    # the split is read twice: its hashes are worked out once, and only for the columns that the query gives back
    s = materialize(_heart_split(spark, sf_dir).select("id", "split", *HEART_NUM), "heart-split")
    train = s.where(F.col("split") == "train")
    return neighbors.knn_impute(s, train, "id", HEART_NUM, k=5).select("id", *HEART_NUM)


# --------------------------------------------------------------------------- anomaly detectors, clustering

from riskframe.operators import anomaly, cluster  # noqa: E402

PTS = standins.POINT_COLS


def _scaled_points(spark, sf_dir):
    p = standins.points(spark, sf_dir)
    return prep.apply_standard(p, prep.fit_standard(p, PTS))


@register("ecod_copod")
def q_ecod_copod(spark, sf_dir):
    return anomaly.tail_scores(standins.points(spark, sf_dir), "vec_id", PTS)


@register("ecdf")
def q_ecdf(spark, sf_dir):
    return anomaly.ecdf_tails(standins.points(spark, sf_dir), "vec_id", PTS).select("vec_id", "feature", "left", "right")


@register("contamination_cut")
def q_contamination_cut(spark, sf_dir):
    s = anomaly.tail_scores(standins.points(spark, sf_dir), "vec_id", PTS)
    return anomaly.contamination_cut(s, "ecod").select("vec_id", "flag")


def _votes(spark, sf_dir):
    return anomaly.column_votes(standins.obs(spark, sf_dir), "id", OBS_NUM)


@register("stack_detector_votes")
def q_stack_detector_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@register("anomaly_counts")
def q_anomaly_counts(spark, sf_dir):
    return anomaly.anomaly_counts(_votes(spark, sf_dir))


@register("anomaly_consensus")
def q_anomaly_consensus(spark, sf_dir):
    return anomaly.anomaly_consensus(_votes(spark, sf_dir), "id", n_detectors=len(OBS_NUM))


@register("normalize_anomaly_flag")
def q_normalize_anomaly_flag(spark, sf_dir):
    v = _votes(spark, sf_dir).withColumn("raw", F.when(F.col("flag") == -1, 1).otherwise(0))
    return v.select("id", "detector", scalar.normalize_anomaly_flag("raw").alias("flag"))


@register("mahalanobis")
def q_mahalanobis(spark, sf_dir):
    return anomaly.mahalanobis(standins.points(spark, sf_dir), "vec_id", ["x1", "x2"])


@register("dbscan")
def q_dbscan(spark, sf_dir):
    return cluster.dbscan(_scaled_points(spark, sf_dir), "vec_id", PTS, eps=2.0, min_samples=5)


@register("eps_range_self_join")
def q_eps_range_self_join(spark, sf_dir):
    pairs = neighbors.eps_pairs(_scaled_points(spark, sf_dir), "vec_id", PTS, eps=2.0, counted=True)
    return pairs.groupBy("a").agg(F.sum("n").alias("degree")).withColumnRenamed("a", "vec_id")


# --------------------------------------------------------------------------- estimators

from riskframe.operators import isotonic, models, smote as smote_op  # noqa: E402


def _labelled_points(spark, sf_dir):
    p = standins.points(spark, sf_dir)
    return p.withColumn("y", (F.col("label") >= 7).cast("int"))


def _points_split(spark, sf_dir):
    return split.stratified_split(_labelled_points(spark, sf_dir), "vec_id", "y", test=0.2, seed=42)


@register("gaussian_nb")
def q_gaussian_nb(spark, sf_dir):
    p = _labelled_points(spark, sf_dir)
    m = models.gaussian_nb_fit(p, "y", PTS, var_smoothing=1e-9)
    proba = models.gaussian_nb_proba(m)
    return p.select("vec_id", proba.alias("p")).withColumn("pred", (F.col("p") > 0.5).cast("int"))


@register("knn_classifier")
def q_knn_classifier(spark, sf_dir):
    s = _points_split(spark, sf_dir)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return models.knn_classifier(train, test, "vec_id", "y", PTS, k=5)


@register("knn_join")
def q_knn_join(spark, sf_dir):
    p = standins.points(spark, sf_dir)
    return neighbors.knn_join(p, p, "vec_id", "vec_id", PTS, k=5, exclude_self=True).select(
        F.col("q_id").alias("vec_id"), F.col("r_id").alias("neighbor_id"), "dist", "rank")


@register("smote")
def q_smote(spark, sf_dir):
    return smote_op.smote(_labelled_points(spark, sf_dir).select("vec_id", "y", *PTS), "vec_id", "y", PTS, k=5, seed=42)


@register("isotonic_fit")
def q_isotonic_fit(spark, sf_dir):
    return isotonic.isotonic_fit(standins.scored(spark, sf_dir), "y", "p", by=["m"])


# --------------------------------------------------------------------------- explanations and cascade

from riskframe.operators import explain  # noqa: E402
from riskframe.operators.curves import cost_optimal_threshold  # noqa: E402
from riskframe.plans import cascade  # noqa: E402


def _nb_points(spark, sf_dir):
    p = _labelled_points(spark, sf_dir)
    return p, models.gaussian_nb_fit(p, "y", PTS, var_smoothing=1e-9)


def _phi(spark, sf_dir):
    p, m = _nb_points(spark, sf_dir)
    return explain.additive_shap(p, "vec_id", models.gaussian_nb_logodds_terms(m))


@register("shap_additive")
def q_shap_additive(spark, sf_dir):
    return _phi(spark, sf_dir)[0]


@register("mean_abs_shap")
def q_mean_abs_shap(spark, sf_dir):
    return explain.mean_abs_shap(_phi(spark, sf_dir)[0])


@register("rank_factors")
def q_rank_factors(spark, sf_dir):
    return explain.rank_factors(_phi(spark, sf_dir)[0], "vec_id")


@register("top_factors")
def q_top_factors(spark, sf_dir):
    return explain.top_factors(_phi(spark, sf_dir)[0], "vec_id", n=4, min_abs=0.001)


@register("waterfall_table")
def q_waterfall_table(spark, sf_dir):
    phi, base = _phi(spark, sf_dir)
    return explain.waterfall_table(phi, "vec_id", base, max_display=10)


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    p, m = _nb_points(spark, sf_dir)
    pred = lambda x: (models.gaussian_nb_proba(m, x) > 0.5).cast("int")
    return explain.permutation_importance(p, "vec_id", "y", PTS, pred, repeats=10, seed=42)


def _cascade(spark, sf_dir):
    p, m = _nb_points(spark, sf_dir)
    gate_scores = anomaly.tail_scores(p, "vec_id", PTS)
    flags = anomaly.contamination_cut(gate_scores, "ecod").select("vec_id", "flag")
    scored = p.withColumn("p", models.gaussian_nb_proba(m))
    t = cost_optimal_threshold(scored, "y", "p").first()["threshold"]
    gated = p.join(flags, "vec_id")
    return cascade.score_cascade(gated, "vec_id", PTS, models.gaussian_nb_proba(m), gate=F.col("flag"), threshold=t)


@register("score_cascade")
def q_score_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir)


@register("explain_cascade")
def q_explain_cascade(spark, sf_dir):
    phi, _ = _phi(spark, sf_dir)
    return cascade.explain_cascade(_cascade(spark, sf_dir), explain.factor_text(phi, "vec_id"), "vec_id")


# --------------------------------------------------------------------------- rows-only checks (no exact SQL form)

from riskframe.functions.rng import h  # noqa: E402
from riskframe.operators import bootstrap, search  # noqa: E402
from riskframe.session import materialize  # noqa: E402


@register("bootstrap_given_weights")
def q_bootstrap_given_weights(spark, sf_dir):
    """Metrics of 12 resamples whose weights are a hash of the cell, by the ranges and vectors of ``bootstrap_ci``."""
    cells = _scored(spark, sf_dir).groupBy("m", "pi", "p", "y", "pred").agg(F.count(F.lit(1)).alias("c"))
    key = F.concat_ws("|", "m", "pi", "y")
    w = F.array(*[F.col("c") * (h(f"boot{b}", key) % 3) for b in range(12)])
    return bootstrap.iteration_metrics(cells.select("m", "p", "y", "pred", w.alias("w")), 12, by=["m"], cells_per_range=500)


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    """Poisson cell bootstrap, 1000 iterations, per model."""
    return bootstrap.bootstrap_ci(_scored(spark, sf_dir), "y", "pred", "p", by=["m"], n_iterations=1000, seed=42)


@register("iforest")
def q_iforest(spark, sf_dir):
    p = _scaled_points(spark, sf_dir)
    nodes = anomaly.iforest_fit(p, "vec_id", PTS, trees=100, sample=256, seed=42)
    s = anomaly.iforest_score(p, "vec_id", PTS, nodes, sample=256)
    return anomaly.contamination_cut(s, "score")


@register("elliptic_envelope")
def q_elliptic_envelope(spark, sf_dir):
    s = anomaly.elliptic_envelope(standins.points(spark, sf_dir), "vec_id", PTS)
    return anomaly.contamination_cut(s, "score")


@register("kmeans")
def q_kmeans(spark, sf_dir):
    _, assign = cluster.kmeans(_scaled_points(spark, sf_dir), "vec_id", PTS, k=2, n_init=10, seed=42)
    return assign


@register("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    """Means of the raw features per cluster, clusters around the labels' centres."""
    raw = standins.points(spark, sf_dir)
    return cluster.cluster_profile(raw.join(q_kmeans_assign(spark, sf_dir), "vec_id"), "cluster", PTS)


@register("kmeans_k_sweep")
def q_kmeans_k_sweep(spark, sf_dir):
    sample = materialize(cluster.downsample(_scaled_points(spark, sf_dir), "vec_id", 20000, seed=42), "sweep")
    found = cluster.kmeans_centres(sample, "vec_id", PTS, range(2, 10), n_init=20, seed=42)  # all k in the same scans
    rows = []
    for k in range(2, 10):
        _, a = cluster.kmeans(sample, "vec_id", PTS, k=k, n_init=20, seed=42, found=found)
        rows.append((k, cluster.silhouette_exact(sample.join(a, "vec_id"), "vec_id", PTS, "cluster")))
    return spark.createDataFrame(rows, "k int, silhouette double")


@register("gmm")
def q_gmm(spark, sf_dir):
    return cluster.gmm(_scaled_points(spark, sf_dir), "vec_id", PTS, k=2, seed=42)


@register("pca_2d")
def q_pca_2d(spark, sf_dir):
    proj, _ = cluster.pca_2d(_scaled_points(spark, sf_dir), "vec_id", PTS, k=2)
    return proj


@register("silhouette")
def q_silhouette(spark, sf_dir):
    """DBSCAN and GMM silhouettes of all rows: squared-Euclidean (linear) and Euclidean (all pairs)."""
    p = _scaled_points(spark, sf_dir)
    out = []
    for method, labels in (("dbscan", cluster.dbscan(p, "vec_id", PTS, eps=2.0, min_samples=5)),
                           ("gmm", cluster.gmm(p, "vec_id", PTS, k=2, seed=42).select("vec_id", "cluster"))):
        j = materialize(p.join(labels, "vec_id"), "sil")
        out.append((method, cluster.silhouette_sq(j, PTS, "cluster"),
                    cluster.silhouette_exact(j, "vec_id", PTS, "cluster")))
    return spark.createDataFrame(out, "method string, silhouette_sq double, silhouette double")


@register("silhouette_labels")
def q_silhouette_labels(spark, sf_dir):
    """Silhouettes of the given labels as clusters: squared and Euclidean distances, on all rows."""
    p = materialize(_scaled_points(spark, sf_dir), "sil")
    return spark.createDataFrame([(cluster.silhouette_sq(p, PTS, "label"),
                                   cluster.silhouette_exact(p, "vec_id", PTS, "label"))],
                                 "silhouette_sq double, silhouette double")


def _classifiers(n_features: int, n_train: int):
    return {
        "logistic_regression": lambda: models.logistic(c=1.0, n=n_train),
        "decision_tree": lambda: models.decision_tree(max_depth=5),
        "random_forest": lambda: models.random_forest(n_estimators=50, max_depth=8),
        "xgboost": lambda: models.boosted_trees("xgboost", n_estimators=30),
        "lightgbm": lambda: models.boosted_trees("lightgbm", n_estimators=30),
        "catboost": lambda: models.boosted_trees("catboost", n_estimators=30),
        "neural_network": lambda: models.mlp(n_features, hidden=(16,), max_iter=200),
    }


def _fitted_scores(spark, sf_dir):
    s = _points_split(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    train = search.assemble(s.where(F.col("split") == "train"), PTS)
    test = search.assemble(s.where(F.col("split") == "test"), PTS)
    n = train.count()
    outs = []
    for name, make in _classifiers(len(PTS), n).items():
        m = make().setLabelCol("y").setFeaturesCol("features").fit(train)
        outs.append(search.score_model(m, test, "vec_id", "y").withColumn("model", F.lit(name)))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.withColumn("y", F.col("y").cast("int"))


@register("compare_models_fitted")
def q_compare_models_fitted(spark, sf_dir):
    return metrics.compare_models(_fitted_scores(spark, sf_dir), "model", "y", "pred", "p")


@register("clf_svm_rbf")
def q_clf_svm_rbf(spark, sf_dir):
    from pyspark.ml.classification import LinearSVC
    s = _points_split(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    gamma = models.gamma_scale(s.where(F.col("split") == "train"), PTS)
    z = models.random_fourier_features(s, PTS, gamma, n_components=64, seed=42)
    zc = [f"rff{i}" for i in range(64)]
    v = search.assemble(z, zc)
    make = lambda: LinearSVC(regParam=0.01, maxIter=100)
    m = make().setLabelCol("y").fit(v.where(F.col("split") == "train"))
    folds = search.fold_tables(z.where(F.col("split") == "train"), "vec_id", "y", zc, k=3, seed=42)
    sigmoid = search.fit_sigmoid(folds, make, "y")
    return search.score_model(m, v.where(F.col("split") == "test"), "vec_id", "y", sigmoid)


@register("grid_search_recall")
def q_grid_search_recall(spark, sf_dir):
    p = _labelled_points(spark, sf_dir).select("vec_id", "y", *PTS)
    folds = search.fold_tables(p, "vec_id", "y", PTS, k=5, seed=42,
                               resample=lambda d: smote_op.smote(d, "vec_id", "y", PTS).drop("synthetic"))
    grid = models.param_grid_expand({"max_depth": [2, 4, 6], "criterion": ["gini", "entropy"]})
    res, _ = search.grid_search_recall(folds, "vec_id", "y",
                                       lambda g: models.decision_tree(g["criterion"], g["max_depth"]), grid)
    return search.grid_results_rank(res)


def _point_folds(spark, sf_dir):
    """[(train, valid)] of the labelled points in five stratified folds."""
    p = _labelled_points(spark, sf_dir).select("vec_id", "y", *PTS)
    folds = materialize(split.stratified_kfold(p, "vec_id", "y", 5, 42), "folds")
    return [(folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)) for f in range(5)]


@register("grid_search_naive_bayes")
def q_grid_search_naive_bayes(spark, sf_dir):
    """Mean held-out recall at every point of the naive Bayes grid, from one fit a fold."""
    res = shared_search.nb_search(_point_folds(spark, sf_dir), "y", PTS, grids.points("heart", "naive_bayes"))
    return res.groupBy("grid_id").agg(F.avg("recall").alias("mean_recall"))


@register("grid_search_knn")
def q_grid_search_knn(spark, sf_dir):
    """Mean held-out recall at every point of the kNN grid, from one join a fold and metric."""
    res = shared_search.knn_search(_point_folds(spark, sf_dir), "vec_id", "y", PTS, grids.points("heart", "knn"))
    return res.groupBy("grid_id").agg(F.avg("recall").alias("mean_recall"))


@register("calibrate_isotonic")
def q_calibrate_isotonic(spark, sf_dir):
    s = _points_split(spark, sf_dir)
    train = s.where(F.col("split") == "train").withColumn("y", F.col("y").cast("double"))
    test = s.where(F.col("split") == "test")
    cal = search.calibrate_isotonic(train, "vec_id", "y", PTS,
                                    lambda: models.boosted_trees("lightgbm", n_estimators=20), test, cv=3)
    return cal.join(test.select("vec_id", "y"), "vec_id")


@register("calibration_comparison")
def q_calibration_comparison(spark, sf_dir):
    cal = q_calibrate_isotonic(spark, sf_dir)
    long = (cal.select("vec_id", "y", F.lit("raw").alias("model"), F.col("p_raw").alias("p"))
            .unionByName(cal.select("vec_id", "y", F.lit("calibrated").alias("model"), "p"))
            .withColumn("pred", metrics.apply_threshold("p", 0.5)))
    cm = metrics.compare_models(long, "model", "y", "pred", "p")
    return cm.join(metrics.brier_score(long, "y", "p", by=["model"]), "model")


from riskframe.session import materialize  # noqa: E402


# --------------------------------------------------------------------------- sources, sinks, stream

from pyspark.sql import types as T  # noqa: E402

from riskframe.sources import patients, sinks  # noqa: E402
from riskframe.operators.quantiles import column_quantiles  # noqa: E402
from riskframe.operators import shared_search  # noqa: E402
from riskframe.plans import grids  # noqa: E402
from riskframe.streaming import score_stream as stream  # noqa: E402

HEART_CSV_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in HEART_NUM]
    + [T.StructField(c, T.StringType()) for c in ("sex", "cp", "thal")]
    + [T.StructField("fbs", T.BooleanType()), T.StructField("num", T.IntegerType())])


def _scratch(spark, tag):
    import uuid
    from riskframe.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-{tag}-{uuid.uuid4().hex}"


@register("scan_patients_csv")
def q_scan_patients_csv(spark, sf_dir):
    """Round trip: heart rows written as CSV with 'NA' for missing values, read
    back with an explicit schema, NA → NULL, NULL target rows dropped."""
    path = _scratch(spark, "csv")
    h = standins.heart_obs(spark, sf_dir).select(*[f.name for f in HEART_CSV_SCHEMA.fields])
    h.write.option("header", True).option("nullValue", "NA").csv(path)
    return patients.scan_patients_csv(spark, path, HEART_CSV_SCHEMA, target="num")


@register("metrics_document")
def q_metrics_document(spark, sf_dir):
    """One metrics document per model, written as JSON and read back: every table is made once for all models."""
    # the operators read the scores eight times over: the view, dear by its hashes and its fan-out, is made once
    s = materialize(_scored(spark, sf_dir).select("m", "y", "p", "pred"), "doc-scored")
    by = ["m"]
    opt = materialize(curves.cost_optimal_threshold(s, "y", "p", by), "doc-cut")
    at_opt = s.join(opt.select("m", F.col("threshold").alias("_cut")), "m").withColumn("pred", (F.col("p") >= F.col("_cut")).cast("int"))
    parts = [materialize(t, "doc") for t in (
        metrics.core_metrics(s, by=by), metrics.core_metrics(at_opt.drop("_cut"), by=by), opt, metrics.brier_score(s, "y", "p", by),
        bootstrap.bootstrap_ci(s, "y", "pred", "p", by, n_iterations=1000))]
    out = None
    for (m,) in sorted(opt.select("m").collect()):  # one row per model
        doc = sinks.metrics_document(*[t.where(F.col("m") == m).drop("m") for t in parts])
        one = sinks.sink_metrics_json(spark, doc, _scratch(spark, f"metrics-{m}")).withColumn("m", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@register("score_cascade_stream")
def q_score_cascade_stream(spark, sf_dir):
    """Points land as JSON files; a file stream scores them with the fitted
    Naive Bayes model behind a Mahalanobis gate on the first two features (both
    per-row expressions)."""
    p, m = _nb_points(spark, sf_dir)
    mu, cov = anomaly.mean_cov(p, PTS[:2])
    d2 = anomaly.mahalanobis_expr(PTS[:2], mu, cov)
    cut = column_quantiles(p.select(d2.alias("d")), ["d"], [0.95])["d"][0]
    src, out = _scratch(spark, "stream-in"), _scratch(spark, "stream-out")
    p.select("vec_id", *PTS).write.json(src)
    schema = T.StructType([T.StructField("vec_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in PTS])
    gate = F.when(d2 > F.lit(cut), F.lit(-1)).otherwise(F.lit(1))
    stream.score_stream(spark, src, schema,
                        lambda df: cascade.score_cascade(df, "vec_id", PTS, models.gaussian_nb_proba(m), gate=gate),
                        out)
    return spark.read.parquet(out)


# --------------------------------------------------------------------------- remaining projections, top-k, reshape

@register("kidney_features")
def q_kidney_features(spark, sf_dir):
    k = standins.kidney_obs(spark, sf_dir)
    k = features.cast_target_int(features.drop_null_target(k, "ckd_present"), "ckd_present")
    return features.kidney_features(k).select("participant_id", *features.KIDNEY_DERIVED)


@register("top_importances")
def q_top_importances(spark, sf_dir):
    return (explain.mean_abs_shap(_phi(spark, sf_dir)[0])
            .orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(10))


@register("preview_rows")
def q_preview_rows(spark, sf_dir):
    return standins.obs(spark, sf_dir).orderBy("id").limit(5)


@register("explain_sample")
def q_explain_sample(spark, sf_dir):
    """The 200-row explanation sample: first rows in hash order (a sampling operator)."""
    from riskframe.functions.rng import h
    p = standins.points(spark, sf_dir)
    return p.orderBy(h(42, "vec_id"), "vec_id").limit(200).select("vec_id", *PTS)


@register("downsample")
def q_downsample(spark, sf_dir):
    return cluster.downsample(standins.points(spark, sf_dir), "vec_id", 20000, seed=42).select("vec_id")


@register("transpose_table")
def q_transpose_table(spark, sf_dir):
    d = profile.describe_numeric(standins.obs(spark, sf_dir), OBS_NUM)
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    long = d.select("feature", *[F.col(s_).cast("double").alias(s_) for s_ in stats]).unpivot(
        ["feature"], stats, "stat", "value")
    return long.groupBy("stat").pivot("feature", OBS_NUM).agg(F.first("value"))


@register("format_metrics")
def q_format_metrics(spark, sf_dir):
    c = _comparison(spark, sf_dir)
    return c.select("model", scalar.fmt("accuracy", "%.4f").alias("accuracy_txt"),
                    scalar.fmt(F.col("recall") * 100.0, "%.2f%%").alias("recall_pct"),
                    scalar.fmt(F.col("f1_score") - F.col("precision"), "%+.2f").alias("f1_minus_precision"))


@register("feature_names")
def q_feature_names(spark, sf_dir):
    stats = prep.fit_one_hot(_train(spark, sf_dir), OBS_CAT)
    raw = F.concat(F.lit("cat__"), F.col("column_name"), F.lit("_"), F.col("value"))
    return stats.select(raw.alias("raw_name"), scalar.strip_feature_prefix(raw).alias("feature"),
                        scalar.humanize_feature(scalar.strip_feature_prefix(raw)).alias("display_name"))


@register("bool_to_label")
def q_bool_to_label(spark, sf_dir):
    h_ = standins.heart_obs(spark, sf_dir)
    return h_.groupBy(scalar.bool_to_label("fbs").alias("fbs")).agg(F.count(F.lit(1)).alias("n"))


def _obs_preprocessed(spark, sf_dir):
    s = _split(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    imputed = neighbors.knn_impute(s, train, "id", OBS_NUM, k=5)
    stats = prep.fit_robust(imputed.where(F.col("split") == "train"), OBS_NUM)
    return prep.apply_robust(imputed, stats)


@register("preprocess_pipeline")
def q_preprocess_pipeline(spark, sf_dir):
    """Numeric branch of the column transformer: kNN impute (fit on train) →
    robust scale (fit on the imputed train rows)."""
    return _obs_preprocessed(spark, sf_dir).select("id", *OBS_NUM)


@register("unsupervised_matrix")
def q_unsupervised_matrix(spark, sf_dir):
    """Numeric columns minus key/target → kNN impute (all rows) → standard scale."""
    o = standins.obs(spark, sf_dir)
    imputed = neighbors.knn_impute(o, o, "id", OBS_NUM, k=5)
    return prep.apply_standard(imputed, prep.fit_standard(imputed, OBS_NUM)).select("id", *OBS_NUM)


@register("kmeans_assign")
def q_kmeans_assign(spark, sf_dir):
    p = _scaled_points(spark, sf_dir)
    centers = [[r[c] for c in PTS] for r in
               p.groupBy("label").agg(*[F.avg(c).alias(c) for c in PTS]).orderBy("label").collect()]
    return cluster.kmeans_assign(p, "vec_id", PTS, centers)


@register("score_direct")
def q_score_direct(spark, sf_dir):
    p, m = _nb_points(spark, sf_dir)
    return cascade.score_direct(p, "vec_id", PTS, models.gaussian_nb_proba(m), threshold=None)


@register("autoencoder_recon")
def q_autoencoder_recon(spark, sf_dir):
    s = anomaly.autoencoder_recon(_scaled_points(spark, sf_dir), "vec_id", PTS, k=2)
    return anomaly.contamination_cut(s, "score")


@register("one_class_svm")
def q_one_class_svm(spark, sf_dir):
    s = anomaly.one_class_svm(_scaled_points(spark, sf_dir), "vec_id", PTS)
    return anomaly.contamination_cut(s, "score")


@register("shap_sampling")
def q_shap_sampling(spark, sf_dir):
    from riskframe.functions.rng import h
    p, m = _nb_points(spark, sf_dir)
    background = p.orderBy(h(7, "vec_id"), "vec_id").limit(50)
    return explain.sampling_shap(p, "vec_id", PTS, lambda x: models.gaussian_nb_proba(m, x), background,
                                 n_permutations=20)


@register("detector_ensemble")
def q_detector_ensemble(spark, sf_dir):
    """Six detectors on the scaled points, votes stacked: (vec_id, detector, flag)."""
    p = _scaled_points(spark, sf_dir)
    tails = anomaly.tail_scores(p, "vec_id", PTS)
    nodes = anomaly.iforest_fit(p, "vec_id", PTS, trees=100, sample=256, seed=42)
    dets = {
        "isolation_forest": anomaly.iforest_score(p, "vec_id", PTS, nodes),
        "elliptic_envelope": anomaly.elliptic_envelope(p, "vec_id", PTS),
        "one_class_svm": anomaly.one_class_svm(p, "vec_id", PTS),
        "ecod": tails.select("vec_id", F.col("ecod").alias("score")),
        "copod": tails.select("vec_id", F.col("copod").alias("score")),
        "autoencoder": anomaly.autoencoder_recon(p, "vec_id", PTS, k=2),
    }
    votes = None
    for name, sc in dets.items():
        v = anomaly.contamination_cut(sc, "score").select("vec_id", F.lit(name).alias("detector"), "flag")
        votes = v if votes is None else votes.unionByName(v)
    return votes


@register("shap_tree")
def q_shap_tree(spark, sf_dir):
    """TreeSHAP of a boosted-tree model (catboost role) for every row of the test
    split; (vec_id, feature, phi) in margin units."""
    s = _points_split(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    train = search.assemble(s.where(F.col("split") == "train"), PTS)
    m = models.boosted_trees("catboost", n_estimators=20).setLabelCol("y").fit(train)
    phi, _ = explain.tree_shap(m, s.where(F.col("split") == "test"), "vec_id", PTS)
    return phi
