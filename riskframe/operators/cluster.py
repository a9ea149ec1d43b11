"""Clustering: DBSCAN, k-means (+ sweep), GMM, PCA, silhouette, profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.components import component_labels
from riskframe.operators.density import density_clusters
from riskframe.session import materialize


# ------------------------------------------------------------------ connected components

def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label = min id of its component) of every vertex; see ``component_labels``."""
    found = component_labels(edges, "a", "b")
    alone = vertices.select("id").join(found, "id", "left_anti").select("id", F.col("id").alias("label"))
    return found.unionByName(alone)


# ------------------------------------------------------------------ DBSCAN

def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 2.0, min_samples: int = 5) -> DataFrame:
    """(key, cluster): density clusters, −1 = noise; see ``density_clusters``."""
    return density_clusters(df, key, cols, eps, min_samples)


# ------------------------------------------------------------------ k-means, GMM, PCA

def _vectors(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


#: Centres of all runs times rows whose distances a task holds at a time.
KMEANS_STEP = 1 << 20


def _lloyd_sums(runs: list[np.ndarray]):
    """Per partition and run: each centre's sum and number of rows, and the run's cost, as arrays in one row."""
    def run(batches):
        import pandas as pd
        stacked = np.concatenate(runs)
        ends = np.cumsum([len(c) for c in runs])
        half = (stacked * stacked).sum(axis=1) / 2
        sums, sizes, costs = np.zeros(stacked.shape), np.zeros(len(stacked)), np.zeros(len(runs))
        for b in batches:
            x = np.array(b["x"].tolist(), np.float64).reshape(len(b), stacked.shape[1])
            step = max(1, KMEANS_STEP // len(stacked))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                away = half - part @ stacked.T
                for i, (end, c) in enumerate(zip(ends, runs)):
                    own = slice(end - len(c), end)
                    to = away[:, own].argmin(axis=1)
                    sizes[own] += np.bincount(to, minlength=len(c))
                    for d in range(x.shape[1]):
                        sums[own, d] += np.bincount(to, weights=part[:, d], minlength=len(c))
                    costs[i] += ((part - c[to]) ** 2).sum()
        yield pd.DataFrame({"sums": [sums.ravel()], "sizes": [sizes], "costs": [costs]})
    return run


def kmeans_centres(df: DataFrame, key: str, cols: Sequence[str], ks: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 300,
                   tol: float = 1e-4) -> dict[int, list[np.ndarray]]:
    """{k: [(cost, centres) of each of ``n_init`` runs]}. MLlib draws the first centres of every run (k-means||, seeds
    seed..seed+n_init−1); then one scan moves the centres of all runs that are not yet still, whatever k, by MLlib's rules."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array
    vec = materialize(_vectors(df.select(key, *cols), cols).select(key, "features"), "kmeans").persist()
    try:
        tasks = [(k, i) for k in ks for i in range(n_init)]
        vec.count()

        def first(task):
            start = KMeans(k=task[0], seed=seed + task[1], maxIter=0, featuresCol="features")
            return np.array(start.fit(vec).clusterCenters(), np.float64)

        # independent draws are submitted concurrently from the driver
        with ThreadPoolExecutor(max_workers=8) as pool:
            centres = dict(zip(tasks, pool.map(first, tasks)))
        rows, cost, moving = vec.select(vector_to_array("features").alias("x")), dict.fromkeys(tasks, 0.0), tasks
        for _ in range(max_iter):
            if not moving:
                break
            parts = rows.mapInPandas(_lloyd_sums([centres[t] for t in moving]),
                                     "sums array<double>, sizes array<double>, costs array<double>").collect()  # a row a partition
            sums, sizes, costs = (sum(np.array(p[c]) for p in parts) for c in ("sums", "sizes", "costs"))
            sums, at, still = sums.reshape(-1, len(cols)), 0, set()
            for t, total in zip(moving, costs):
                old = centres[t]
                n, own = sizes[at:at + len(old)], sums[at:at + len(old)]
                at += len(old)
                centres[t] = np.where(n[:, None] > 0, own * (1.0 / np.maximum(n, 1))[:, None], old)
                cost[t] = float(total)
                if (((centres[t] - old) ** 2).sum(axis=1) <= tol * tol).all():
                    still.add(t)
            moving = [t for t in moving if t not in still]
    finally:
        vec.unpersist()
    return {k: [(cost[k, i], centres[k, i]) for i in range(n_init)] for k in ks}


def kmeans(df: DataFrame, key: str, cols: Sequence[str], k: int = 2, n_init: int = 10, seed: int = 42,
           max_iter: int = 300, found: dict[int, list] | None = None):
    """Best of ``n_init`` k-means runs (MLlib's k-means|| init, seeds seed..seed+n_init−1) by training cost, of those that
    ``found`` (``kmeans_centres`` of several k) already has; returns (centres, assignments(key, cluster))."""
    runs = (found or kmeans_centres(df, key, cols, [k], n_init, seed, max_iter))[k]
    centres = min(runs, key=lambda r: r[0])[1]
    return centres, kmeans_assign(df, key, cols, centres.tolist())


def kmeans_assign(df: DataFrame, key: str, cols: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """(key, cluster): nearest centre by squared Euclidean distance (ties → lower index)."""
    d2 = []
    for j, c in enumerate(centers):
        e = None
        for i, col in enumerate(cols):
            t = (F.col(col) - F.lit(float(c[i]))) * (F.col(col) - F.lit(float(c[i])))
            e = t if e is None else e + t
        d2.append(F.struct(e.alias("d"), F.lit(j).alias("j")))
    return df.select(key, F.least(*d2)["j"].cast("long").alias("cluster")) if len(d2) > 1 else \
        df.select(key, F.lit(0).cast("long").alias("cluster"))


def gmm(df: DataFrame, key: str, cols: Sequence[str], k: int = 2, seed: int = 42) -> DataFrame:
    """(key, cluster, probability): full-covariance Gaussian mixture, hard labels."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array
    vec = _vectors(df.select(key, *cols), cols)
    m = GaussianMixture(k=k, seed=seed, featuresCol="features").fit(vec)
    t = m.transform(vec)
    return t.select(key, F.col("prediction").cast("long").alias("cluster"),
                    F.array_max(vector_to_array("probability")).alias("probability"))


def pca_2d(df: DataFrame, key: str, cols: Sequence[str], k: int = 2):
    """Centred PCA: the covariance comes from one distributed aggregate, the d×d
    eigen-decomposition runs on the driver, and the projection is an
    expression. Sign fixed so each component's largest |loading| is positive.
    Returns (projection(key, pc1..pck), explained_variance_ratio)."""
    from riskframe.operators.anomaly import mean_cov
    mu, cov = mean_cov(df, cols)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    proj = []
    for j in range(k):
        e = None
        for i, c in enumerate(cols):
            t = (F.col(c) - F.lit(float(mu[i]))) * F.lit(float(vecs[i, j]))
            e = t if e is None else e + t
        proj.append(e.alias(f"pc{j + 1}"))
    ratio = (vals[:k] / vals.sum()).tolist() if vals.sum() > 0 else [0.0] * k
    return df.select(key, *proj), ratio


# ------------------------------------------------------------------ silhouette

def silhouette_sq(df: DataFrame, cols: Sequence[str], cluster: str) -> float:
    """Mean silhouette with *squared* Euclidean distance, exact and linear:
    mean ‖x−y‖² over a cluster C = ‖x‖² − 2x·μ_C + mean‖y‖²_C. Per-cluster
    sums are one small aggregate (k rows)."""
    sq = sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(sq).alias("msq"),
                                    *[F.avg(c).alias(f"mu_{c}") for c in cols]).collect()
    if len(stats) < 2:
        return float("nan")
    terms = {}
    for s_ in stats:
        dot = sum((F.col(c) * F.lit(float(s_[f"mu_{c}"])) for c in cols[1:]),
                  F.col(cols[0]) * F.lit(float(s_[f"mu_{cols[0]}"])))
        terms[s_[cluster]] = (sq - 2 * dot + F.lit(float(s_["msq"])), int(s_["n"]))
    own = None
    other = None
    for lab, (e, n) in terms.items():
        is_own = F.col(cluster) == F.lit(lab)
        # own-cluster mean excludes the point itself (distance 0): scale by n/(n−1)
        a = F.when(F.lit(n) > 1, e * F.lit(n / max(n - 1, 1)))
        own = F.when(is_own, a) if own is None else own.when(is_own, a)
        cand = F.when(~is_own, e)
        other = cand if other is None else F.least(other, cand)
    s = F.when(own.isNull() | (F.greatest(own, other) == 0), F.lit(0.0)).otherwise(
        F.try_divide(other - own, F.greatest(own, other)))
    return float(df.select(s.alias("s")).agg(F.avg("s")).first()[0])


#: Rows of a block; a larger cluster is cut into blocks of its own.
BLOCK = 8192


#: Rows whose distances to a block are held at a time.
STRIPE = 64


def _close_exact(d2: np.ndarray, x: np.ndarray, y: np.ndarray, limit: float) -> None:
    """Squared distances below ``limit``, where a matrix product loses digits, are worked out from the differences."""
    i, j = np.nonzero(d2 < limit)
    for at in range(0, len(i), 1 << 18):
        p, q = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
        d2[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1)


def _runs(lab: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, lab[1:] != lab[:-1]])


def _distance_sums(a, b, cols: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(own, nearest) per row of ``a`` against the rows of ``b``, then the same of ``b`` against ``a`` (both sorted by cluster):
    sum of the distances to its own cluster, smallest mean distance to another cluster that lies on the other side as a
    whole. Each distance is worked out once for both sides."""
    x, y = a[cols].to_numpy(dtype=float), b[cols].to_numpy(dtype=float)
    mid = y.mean(axis=0)
    x, y = x - mid, y - mid
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left = np.column_stack([x, xx, np.ones(len(x))])
    right = np.ascontiguousarray(np.column_stack([-2 * y, np.ones(len(y)), yy]).T)
    limit = 1e-6 * (xx.max() + yy.max())
    la, lb = a["_c"].to_numpy(), b["_c"].to_numpy()
    fa, fb = _runs(la), _runs(lb)
    size_a, size_b = a["_n"].to_numpy()[fa], b["_n"].to_numpy()[fb]
    at = np.minimum(np.searchsorted(lb[fb], la), len(fb) - 1)
    mine = lb[fb][at] == la
    own, nearest = np.zeros(len(x)), np.full(len(x), np.inf)
    theirs, near_b, open_sum = np.zeros(len(y)), np.full(len(y), np.inf), np.zeros(len(y))
    ends = np.r_[fa[1:], len(x)]
    for lo in range(0, len(x), STRIPE):
        part = slice(lo, min(lo + STRIPE, len(x)))
        d = left[part] @ right
        _close_exact(d, x[part], y, limit)
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        sums = np.add.reduceat(d, fb, axis=1)
        rows, m = np.arange(len(sums)), mine[part]
        own[part] = np.where(m, sums[rows, at[part]], 0.0)
        means = sums / size_b
        means[rows[m], at[part][m]] = np.inf
        nearest[part] = means.min(axis=1)
        for r in range(np.searchsorted(ends, part.start, side="right"), np.searchsorted(fa, part.stop)):
            open_sum += d[max(fa[r], part.start) - lo:min(ends[r], part.stop) - lo].sum(axis=0)
            if ends[r] <= part.stop:
                same = lb == la[fa[r]]
                theirs = np.where(same, open_sum, theirs)
                near_b = np.where(same, near_b, np.minimum(near_b, open_sum / size_a[r]))
                open_sum = np.zeros(len(y))
    return [(own, nearest), (theirs, near_b)]


def silhouette_exact(df: DataFrame, key: str, cols: Sequence[str], cluster: str) -> float:
    """Mean Euclidean silhouette of all rows, exact, every pair of rows compared.

    Clusters of more than ``BLOCK`` rows are cut into blocks of their own, the others share blocks as wholes.
    Each pair of blocks is one bounded group; it gives back a row per point and block with a partial sum for
    one cluster and the smallest mean among the clusters that the block holds as wholes. A grouped sum joins them.
    The work grows with the square of the rows; ``silhouette_sq`` is linear."""
    import pandas as pd
    cols = list(cols)
    rows = df.select(F.monotonically_increasing_id().alias("_r"), F.col(cluster).alias("_c"),
                     *[F.col(c).cast("double").alias(c) for c in cols])
    rows = materialize(rows, "silhouette-rows")
    sizes = materialize(rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")), "silhouette-sizes")
    k, rest = sizes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_n") <= BLOCK, F.col("_n")))).first()
    if k < 2:
        return float("nan")
    cut, blocks = [], 0
    for r in sizes.where(F.col("_n") > BLOCK).orderBy("_c").collect():  # at most a row a block
        parts = -(-r["_n"] // BLOCK)
        cut.append((r["_c"], blocks, parts))
        blocks += parts
    kind = rows.schema["_c"].dataType.simpleString()
    bins = -(-(rest or 0) // BLOCK)
    placed = sizes.join(df.sparkSession.createDataFrame(cut, f"_c {kind}, _first int, _parts int"), "_c", "left")
    block = F.when(F.col("_parts").isNotNull(), F.col("_first") + F.pmod(F.xxhash64("_r"), F.col("_parts")))
    if bins:
        block = block.otherwise(F.lit(blocks) + F.pmod(F.xxhash64("_c"), F.lit(bins)))
    blocks += bins
    sent = (rows.join(placed, "_c").select("_r", "_c", "_n", *cols, block.cast("int").alias("_b"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumn("_low", F.least("_b", "_o")).withColumn("_high", F.greatest("_b", "_o")).drop("_o"))
    first_shared = blocks - bins

    def compare(pdf):
        pdf = pdf.sort_values(["_b", "_c"], kind="stable")
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        sides = {n: g for n, g in pdf.groupby("_b", sort=False)}
        out = []
        if low not in sides or high not in sides:
            return pd.DataFrame({x: [] for x in ("_r", "_own", "_c", "_n", "_sum", "_near")})
        both = zip(((low, high), (high, low)), _distance_sums(sides[low], sides[high], cols))
        for (i, j), (own, nearest) in both if low != high else [*both][:1]:
            a, b = sides[i], sides[j]
            c, n = a["_c"].to_numpy(), a["_n"].to_numpy()
            if j < first_shared:  # a block of one cluster that has others: only its sum is known here
                inside = c == b["_c"].iloc[0]
                own = np.where(inside, own, nearest * b["_n"].iloc[0])
                nearest, c, n = np.full(len(a), np.inf), b["_c"].iloc[0], b["_n"].iloc[0]
            out.append(pd.DataFrame({"_r": a["_r"].to_numpy(), "_own": a["_c"].to_numpy(), "_c": c, "_n": n,
                                     "_sum": own, "_near": nearest}))
        return pd.concat(out)

    sums = (sent.groupBy("_low", "_high")
            .applyInPandas(compare, f"_r long, _own {kind}, _c {kind}, _n long, _sum double, _near double")
            .groupBy("_r", "_own", "_c").agg(F.max("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.min("_near").alias("_near")))
    mine = F.col("_c") == F.col("_own")
    per = sums.groupBy("_r").agg(
        F.max(F.when(mine, F.col("_n"))).alias("n"),
        F.max(F.when(mine, F.col("_sum") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("a"),
        F.min(F.least("_near", F.when(~mine, F.col("_sum") / F.col("_n")))).alias("b"))
    s = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return float(per.agg(F.avg(F.coalesce(s, F.lit(0.0)))).first()[0])


def downsample(df: DataFrame, key: str, n: int = 20000, seed: int = 42) -> DataFrame:
    """At most n rows, without replacement, chosen by hash order (a sampling
    operator: the cap is the feature)."""
    from riskframe.functions.rng import h
    return df.orderBy(h(seed, key), key).limit(n)


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """(feature, cluster, mean)."""
    wide = df.groupBy(cluster).agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([cluster], list(cols), "feature", "mean")
