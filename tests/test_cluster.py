"""k-means runs that share their scans, and silhouettes whose distances come from matrix products."""
import numpy as np

from riskframe.operators import cluster


def _points(spark, n=600):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2)) + 4 * r.integers(0, 4, size=(n, 1))
    return x, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").coalesce(1)


def test_runs_of_several_k_in_the_same_scans_end_where_mllib_ends(spark):
    from pyspark.ml.clustering import KMeans
    _, df = _points(spark)
    found = cluster.kmeans_centres(df, "id", ["a", "b"], [2, 4], n_init=3, seed=42)
    vec = cluster._vectors(df, ["a", "b"]).select("features")
    for k in (2, 4):
        for i, (cost, centres) in enumerate(found[k]):
            m = KMeans(k=k, seed=42 + i, maxIter=300).fit(vec)
            assert abs(m.summary.trainingCost - cost) < 1e-6 * cost and np.allclose(np.array(m.clusterCenters()), centres)
    assert cluster.kmeans(df, "id", ["a", "b"], k=4, n_init=3, found=found)[1].count() == 600


def test_distances_between_two_blocks_serve_both_sides(spark):
    import pandas as pd
    x, _ = _points(spark, 300)
    x += 1e4  # far from the origin, and copies
    x[::7] = x[0]
    lab = np.sort(np.arange(300) % 5)
    n = np.bincount(lab)[lab] + 9
    sides = [pd.DataFrame({"a": x[s, 0], "b": x[s, 1], "_c": lab[s], "_n": n[s]}) for s in (slice(0, 130), slice(110, 300))]
    for (p, q), (own, near) in zip((sides, sides[::-1]), cluster._distance_sums(*sides, ["a", "b"])):
        d = np.sqrt(((p[["a", "b"]].to_numpy()[:, None] - q[["a", "b"]].to_numpy()[None]) ** 2).sum(-1))
        for i, c in enumerate(p["_c"]):
            assert abs(d[i, q["_c"] == c].sum() - own[i]) < 1e-6
            other = [d[i, q["_c"] == o].sum() / m for o, m in dict(zip(q["_c"], q["_n"])).items() if o != c]
            assert abs(min(other, default=np.inf) - near[i]) < 1e-9 or min(other, default=np.inf) == near[i]
