"""Explanations: additive Shapley values, permutation importance, factor tables.

Attributions are kept in long form ``(key, feature, phi)`` so every report
(mean |φ|, top factors, waterfall) is a grouped aggregate or a window over one
row's features — never a wide matrix on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.rng import h
from riskframe.functions.scalar import fixed, humanize_feature
from riskframe.operators.split import stratified_rank


def additive_shap(df: DataFrame, key: str, terms: dict[str, Column], background: DataFrame | None = None
                  ) -> tuple[DataFrame, float]:
    """Exact Shapley values of an additive score f(x) = c + Σ_j g_j(x_j):
    φ_j(x) = g_j(x_j) − E_background[g_j]. Covers linear models (g_j = w_j·x_j)
    and Gaussian naive Bayes log-odds. Returns ((key, feature, phi), base value
    without the constant)."""
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(t).alias(n) for n, t in terms.items()]).first()
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), (t - F.lit(float(means[n]))).alias("phi"))
                     for n, t in terms.items()])
    return df.select(key, F.inline(rows)), float(sum(means[n] for n in terms))


def linear_terms(weights: dict[str, float]) -> dict[str, Column]:
    return {c: F.col(c) * F.lit(float(w)) for c, w in weights.items()}


def mean_abs_shap(phi: DataFrame, feature: str = "feature", value: str = "phi") -> DataFrame:
    """(feature, mean_abs_shap) — sorting is left to the report (a small table)."""
    return phi.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs_shap"))


def rank_factors(phi: DataFrame, key: str) -> DataFrame:
    """phi + ``rank`` per row by |φ| desc (feature name breaks ties). The window
    is partitioned by the row key: one row's features, never a hot group."""
    w = Window.partitionBy(key).orderBy(F.abs(F.col("phi")).desc(), F.col("feature"))
    return phi.withColumn("rank", F.row_number().over(w))


def top_factors(phi: DataFrame, key: str, n: int = 4, min_abs: float = 0.001) -> DataFrame:
    """(key, rank, feature, phi): the first n features with |φ| > min_abs."""
    kept = phi.where(F.abs(F.col("phi")) > F.lit(min_abs))
    return rank_factors(kept, key).where(F.col("rank") <= n)


def factor_text(phi: DataFrame, key: str, n: int = 4, min_abs: float = 0.001) -> DataFrame:
    """(key, explanation): ``'1. Feature Name (+0.12); 2. …'`` ordered by rank."""
    t = top_factors(phi, key, n, min_abs).withColumn(
        "_txt", F.concat(F.col("rank").cast("string"), F.lit(". "), humanize_feature(F.col("feature")),
                         F.lit(" ("), fixed(F.col("phi"), 2, sign=True), F.lit(")")))
    return t.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_txt"))), lambda s: s["_txt"]), "; ").alias("explanation"))


def waterfall_table(phi: DataFrame, key: str, base: float, max_display: int = 10) -> DataFrame:
    """(key, rank, feature, phi, cumulative): the data behind a waterfall plot —
    the top max_display−1 features by |φ| individually, the rest folded into
    one 'other features' row, running total from the base value."""
    r = rank_factors(phi, key)
    keep = F.col("rank") < max_display
    folded = (r.withColumn("feature", F.when(keep, F.col("feature")).otherwise(F.lit("other features")))
              .withColumn("rank", F.when(keep, F.col("rank")).otherwise(F.lit(max_display)))
              .groupBy(key, "rank", "feature").agg(F.sum("phi").alias("phi")))
    run = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return folded.withColumn("cumulative", F.lit(float(base)) + F.sum("phi").over(run))


#: Rows that are permuted among themselves.
PERMUTED = 16_384


def permutation_importance(df: DataFrame, key: str, y: str, cols: Sequence[str],
                           predict: Callable[[dict[str, Column]], Column], repeats: int = 10, seed: int = 42,
                           block: int = PERMUTED) -> DataFrame:
    """(feature, importance_mean): mean drop in accuracy when one feature column
    is permuted, over ``repeats`` hashed permutations per feature.

    Rows in hash order are cut into blocks of ``block``, each a random sample of the table, and every permutation moves
    values inside the blocks: in repeat r of column j the row at position i of its block gets the value of the row
    at position i of the block's order by a hash keyed by (j, r). So the rows are shuffled once, into blocks, whatever
    the number of features and repeats; the variants are made, scored and counted inside the block's task.
    Null values move like others; rows whose prediction or label is null don't count; an empty table gives no rows."""
    cols = list(cols)
    base_acc = df.select((predict({c: F.col(c) for c in cols}) == F.col(y)).cast("double").alias("ok")) \
                 .agg(F.avg("ok")).first()[0]
    variants = [(c, r) for c in cols for r in range(repeats)]
    ranked = stratified_rank(df.select(key, y, *cols).withColumn("_g", F.lit(0)), key, "_g", f"{seed}|base")
    placed = ranked.select(y, *[F.col(c).cast("double").alias(c) for c in cols], F.col(key).cast("string").alias("_key"),
                           F.col("_rank").cast("long").alias("_rank"),
                           F.floor((F.col("_rank") - 1) / F.lit(block)).alias("_block")).repartition("_block")
    prefixes = F.array(*[F.lit(f"{c}|{r}|") for c, r in variants])
    # after the exchange, so that the hashes aren't shuffled
    placed = placed.withColumn("_order", F.transform(prefixes, lambda p: h(seed, F.concat(p, F.col("_key")))))
    schema = T.StructType([placed.schema[y], *[placed.schema[c] for c in cols],
                           *[T.StructField(f"_d{i}", T.DoubleType()) for i in range(len(variants))]])
    donors = placed.groupBy("_block").applyInArrow(_permuted(y, cols, variants), schema)
    grid = F.array(*[F.struct(F.lit(c).alias("_j"), F.lit(r).alias("_r"), F.col(f"_d{i}").alias("_donor"))
                     for i, (c, r) in enumerate(variants)])
    joined = donors.select(y, *cols, F.inline(grid))
    swapped = {c: F.when(F.col("_j") == F.lit(c), F.col("_donor")).otherwise(F.col(c)) for c in cols}
    acc = (joined.select("_j", "_r", (predict(swapped) == F.col(y)).cast("double").alias("ok"))
           .groupBy("_j", "_r").agg(F.avg("ok").alias("acc")))
    return acc.groupBy(F.col("_j").alias("feature")).agg((F.lit(base_acc) - F.avg("acc")).alias("importance_mean"))


def _permuted(y: str, cols: list[str], variants: list[tuple[str, int]]):
    """A block's rows in order of their rank, with a column of donated values for each variant."""

    def run(rows):
        import numpy as np
        import pyarrow as pa
        rows = rows.combine_chunks().sort_by("_rank")
        n = rows.num_rows
        text = np.argsort(np.argsort(np.array(rows["_key"].to_pylist(), object), kind="stable"), kind="stable")
        hashes = rows["_order"].combine_chunks().flatten().to_numpy().reshape(n, len(variants))
        donated = [rows[c].take(pa.array(np.lexsort((text, hashes[:, i])))) for i, (c, _) in enumerate(variants)]
        return pa.table([rows[y], *[rows[c] for c in cols], *donated], names=[y, *cols, *[f"_d{i}" for i in range(len(variants))]])

    return run


def sampling_shap(df: DataFrame, key: str, cols: Sequence[str], score: Callable[[dict[str, Column]], Column],
                  background: DataFrame, n_permutations: int = 20, seed: int = 42) -> DataFrame:
    """(key, feature, phi): model-agnostic Monte-Carlo Shapley values
    (Štrumbelj & Kononenko 2014). For each row and permutation m, features are
    ordered by h(seed, key|m|feature) and switched one by one from a background
    row (picked by hash from the small background set) to the row's own value;
    each switch's score change is that feature's contribution. All synthetic
    rows (rows × permutations × (d+1)) are scored in one batch; Σφ equals
    f(x) − mean f(background row) per permutation, exactly."""
    cols = list(cols)
    d = len(cols)
    bg = background.select(*[F.col(c).alias(f"_b_{c}") for c in cols])
    bg_rows = bg.collect()  # the background set is a bounded sample (e.g. 50 rows)
    nb = len(bg_rows)
    bg_arr = F.array(*[F.struct(*[F.lit(float(r[f"_b_{c}"])).alias(c) for c in cols]) for r in bg_rows])
    perms = df.select(key, *cols, F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("_m"))
    tag = F.concat(F.col(key).cast("string"), F.lit("|"), F.col("_m").cast("string"))
    perms = perms.withColumn("_bg", F.element_at(bg_arr, (h(seed, tag) % nb + 1).cast("int")))
    # position of each feature in this permutation: rank of its hash among the d features
    hs = {c: h(seed, F.concat(tag, F.lit(f"|{c}"))) for c in cols}
    pos = {}
    for c in cols:
        e = F.lit(0)
        for o in cols:
            if o != c:
                e = e + ((hs[o] < hs[c]) | ((hs[o] == hs[c]) & F.lit(o < c))).cast("int")
        pos[c] = e
    perms = perms.withColumns({f"_p_{c}": pos[c] for c in cols})
    steps = perms.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_k"))
    mixed = {c: F.when(F.col(f"_p_{c}") < F.col("_k"), F.col(c)).otherwise(F.col("_bg")[c]) for c in cols}
    scored = steps.select(key, "_m", "_k", *[f"_p_{c}" for c in cols], score(mixed).alias("_f"))
    w = Window.partitionBy(key, "_m").orderBy("_k")
    diffs = scored.withColumn("_d", F.col("_f") - F.lag("_f").over(w)).where(F.col("_k") > 0)
    who = F.lit(None).cast("string")
    for c in cols:
        who = F.when(F.col(f"_p_{c}") == F.col("_k") - 1, F.lit(c)).otherwise(who)
    return diffs.select(key, who.alias("feature"), "_d").groupBy(key, "feature").agg(
        (F.sum("_d") / F.lit(float(n_permutations))).alias("phi"))


# ------------------------------------------------------------------ TreeSHAP for MLlib tree ensembles

def tree_tables(model) -> tuple[list[dict], list[float], str]:
    """Node arrays per tree from an MLlib tree model's saved form (the public
    persistence format): ([{feature, threshold, left, right, cover, value}], tree
    weights, kind). The table is trees × nodes — bounded by the model, not the data."""
    import uuid

    import numpy as np

    from riskframe.session import ensure_checkpoint_dir
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    cls = type(model).__name__
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
        weights = list(getattr(model, "treeWeights", [1.0] * model.getNumTrees))
    else:
        rows = [dict(r.asDict(), treeID=0) for r in data.collect()]
        weights = [1.0]
    kind = "margin" if "GBT" in cls else "proba"
    trees = []
    for t in range(len(weights)):
        nodes = sorted([r if isinstance(r, dict) else r.asDict() for r in rows
                        if (r["treeID"] if isinstance(r, dict) else r["treeID"]) == t], key=lambda r: r["id"])
        n = max(r["id"] for r in nodes) + 1
        feat = np.full(n, -1)
        thr = np.zeros(n)
        left = np.full(n, -1)
        right = np.full(n, -1)
        cover = np.zeros(n)
        value = np.zeros(n)
        for r in nodes:
            i = r["id"]
            stats = r["impurityStats"]
            if kind == "margin":
                cover[i], value[i] = stats[0], r["prediction"]
            else:
                tot = float(sum(stats))
                cover[i] = tot
                value[i] = (stats[1] / tot) if tot > 0 and len(stats) > 1 else 0.0
            if r["leftChild"] >= 0:
                feat[i] = r["split"]["featureIndex"]
                thr[i] = r["split"]["leftCategoriesOrThreshold"][0]
                left[i], right[i] = r["leftChild"], r["rightChild"]
        trees.append({"feature": feat, "threshold": thr, "left": left, "right": right, "cover": cover, "value": value})
    if kind == "proba":
        weights = [1.0 / len(weights)] * len(weights)
    return trees, [float(w) for w in weights], kind


def _leaf_paths(t) -> list[tuple[float, dict[int, tuple[float, list[tuple[float, bool]]]]]]:
    """(value, {feature: (share of the training cover kept by its splits, its splits)}) per leaf; a split
    is (threshold, whether the path goes left)."""
    out = []

    def walk(node, path):
        f = int(t["feature"][node])
        if f < 0:
            out.append((float(t["value"][node]), path))
            return
        for child, goes_left in ((int(t["left"][node]), True), (int(t["right"][node]), False)):
            share, splits = path.get(f, (1.0, []))
            kept = share * float(t["cover"][child]) / float(t["cover"][node])
            walk(child, {**path, f: (kept, [*splits, (float(t["threshold"][node]), goes_left)])})

    walk(0, {})
    return out


def _leaf_shap(x, leaves, phi, scale) -> None:
    """Add the path-dependent Shapley values of one tree (Lundberg et al. 2018) for all rows of ``x``.

    A leaf with m features on its path is a game whose value is the product, over the features, of
    "the row follows the path" (o) for features in the coalition and of the cover share (z) for others. A
    feature's Shapley value is (o − z) times the coefficients of Π(z + o·t) over the other features,
    weighted by k!(m − k − 1)!/m!."""
    import math

    import numpy as np
    for value, path in leaves:
        feats, m = list(path), len(path)
        if not m:
            continue
        z = [path[f][0] for f in feats]
        o = []
        for f in feats:
            follows = np.ones(len(x), bool)
            for threshold, goes_left in path[f][1]:
                follows &= (x[:, f] <= threshold) == goes_left
            o.append(follows.astype(float))
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for i, f in enumerate(feats):
            coef = [np.ones(len(x))]
            for j in range(m):
                if j != i:
                    coef = [(coef[k] * z[j] if k < len(coef) else 0.0) + (coef[k - 1] * o[j] if k else 0.0)
                            for k in range(len(coef) + 1)]
            phi[:, f] += scale * value * (o[i] - z[i]) * sum(w * c for w, c in zip(weight, coef))


def _expected(t) -> float:
    leaves = t["feature"] < 0
    return float((t["cover"][leaves] * t["value"][leaves]).sum() / t["cover"][0])


def tree_shap(model, df: DataFrame, key: str, cols: Sequence[str]) -> tuple[DataFrame, float]:
    """((key, feature, phi), base) for an MLlib tree model: GBT attributions are in
    margin units (Σφ + base = raw margin), forests/trees in class-1 probability.
    The node tables travel with the task closure; rows are explained in
    ``mapInPandas`` batches."""
    import numpy as np
    import pandas as pd
    trees, weights, _ = tree_tables(model)
    base = float(sum(w * _expected(t) for t, w in zip(trees, weights)))
    cols = list(cols)
    paths = [_leaf_paths(t) for t in trees]

    def run(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            phi = np.zeros(x.shape)
            for leaves, w in zip(paths, weights):
                _leaf_shap(x, leaves, phi, w)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(cols)), "feature": cols * len(x),
                                "phi": phi.ravel()})

    ktype = df.schema[key].dataType.simpleString()
    return df.select(key, *cols).mapInPandas(run, f"{key} {ktype}, feature string, phi double"), base
