"""kNN join, DBSCAN and tail scores against brute force on small fixtures."""
import numpy as np
import pytest

from riskframe.operators import anomaly, cluster, neighbors
from riskframe.sources import standins

from conftest import SF001


@pytest.fixture(scope="module")
def pts(spark):
    return standins.points(spark, SF001)


def _brute_knn(x, ids, k, exclude_self):
    out = {}
    for i, qi in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))
        if exclude_self:
            order = [j for j in order if ids[j] != qi]
        out[qi] = [ids[j] for j in order[:k]]
    return out


def test_knn_join_matches_brute_force(spark, pts):
    cols = ["x1", "x2", "x3", "x4"]
    pdf = pts.select("vec_id", *cols).toPandas().sort_values("vec_id")
    x, ids = pdf[cols].to_numpy(), pdf["vec_id"].tolist()
    got = neighbors.knn_join(pts, pts, "vec_id", "vec_id", cols, k=3, exclude_self=True, cell_rows=20).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["q_id"], r["rank"])):
        res.setdefault(r["q_id"], []).append(r["r_id"])
    assert res == _brute_knn(x, ids, 3, True)


def test_dbscan_matches_brute_force(spark, pts):
    cols = ["x1", "x2", "x3"]
    pdf = pts.select("vec_id", *cols).toPandas()
    x, ids = pdf[cols].to_numpy(), pdf["vec_id"].to_numpy()
    eps, ms = 0.08, 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    adj = d <= eps
    core = adj.sum(1) >= ms
    lab = {}
    for i in np.argsort(ids):
        if core[i] and ids[i] not in lab:
            stack, comp = [i], []
            seen = {i}
            while stack:
                j = stack.pop()
                comp.append(j)
                for t in np.where(adj[j] & core)[0]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            m = min(ids[j] for j in comp)
            for j in comp:
                lab[ids[j]] = m
    for i in range(len(ids)):
        if not core[i]:
            cands = [lab[ids[j]] for j in np.where(adj[i] & core)[0]]
            lab[ids[i]] = min(cands) if cands else -1
    got = {r["vec_id"]: r["cluster"] for r in cluster.dbscan(pts, "vec_id", cols, eps=eps, min_samples=ms).collect()}
    assert got == lab
    assert len(set(got.values()) - {-1}) >= 1


def test_tail_scores_flag_five_percent(spark, pts):
    s = anomaly.tail_scores(pts, "vec_id", standins.POINT_COLS)
    flags = anomaly.contamination_cut(s, "ecod")
    n, k = flags.count(), flags.where("flag = -1").count()
    assert abs(k - 0.05 * n) <= 1


def test_iforest_scores_outliers_higher(spark, pts):
    cols = ["x1", "x2"]
    nodes = anomaly.iforest_fit(pts, "vec_id", cols, trees=20, sample=32)
    sc = anomaly.iforest_score(pts, "vec_id", cols, nodes, sample=32).toPandas()
    pdf = pts.select("vec_id", *cols).toPandas().merge(sc, on="vec_id")
    dist = np.sqrt(((pdf[cols] - pdf[cols].mean()) ** 2).sum(1))
    assert np.corrcoef(dist, pdf["score"])[0, 1] > 0.3


def test_sampling_shap_efficiency(spark, pts):
    from pyspark.sql import functions as F
    from riskframe.operators import explain
    cols = ["x1", "x2", "x3"]
    score = lambda x: x["x1"] * 2.0 + x["x2"] * x["x3"]  # noqa: E731  non-additive on purpose
    rows = pts.orderBy("vec_id").limit(5)
    bg = pts.orderBy(F.col("vec_id").desc()).limit(1)  # a single background row ⇒ exact efficiency
    phi = explain.sampling_shap(rows, "vec_id", cols, score, bg, n_permutations=6)
    tot = {r["vec_id"]: r["s"] for r in phi.groupBy("vec_id").agg(F.sum("phi").alias("s")).collect()}
    b = bg.first()
    f_b = b["x1"] * 2.0 + b["x2"] * b["x3"]
    for r in rows.collect():
        assert tot[r["vec_id"]] == pytest.approx(r["x1"] * 2.0 + r["x2"] * r["x3"] - f_b, abs=1e-9)


def test_autoencoder_full_rank_is_zero(spark, pts):
    cols = ["x1", "x2", "x3"]
    s = anomaly.autoencoder_recon(pts, "vec_id", cols, k=3).agg({"score": "max"}).first()[0]
    assert s == pytest.approx(0.0, abs=1e-9)


def test_tree_shap_additivity(spark, pts):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    from riskframe.operators import explain
    from riskframe.operators.search import assemble
    cols = ["x1", "x2", "x3", "x4"]
    d = pts.withColumn("y", (F.col("label") >= 5).cast("double"))
    v = assemble(d, cols)
    for est, raw in ((GBTClassifier(maxIter=5, maxDepth=3, labelCol="y"), "rawPrediction"),
                     (RandomForestClassifier(numTrees=5, maxDepth=3, labelCol="y", seed=1), "probability")):
        m = est.fit(v)
        phi, base = explain.tree_shap(m, d.orderBy("vec_id").limit(20), "vec_id", cols)
        tot = {r["vec_id"]: r["s"] for r in phi.groupBy("vec_id").agg(F.sum("phi").alias("s")).collect()}
        out = m.transform(v.orderBy("vec_id").limit(20)).select("vec_id", vector_to_array(raw)[1].alias("f")).collect()
        for r in out:
            assert tot[r["vec_id"]] + base == pytest.approx(r["f"], abs=1e-6)


def test_connected_components_long_chain(spark):
    # a 300-node path plus a separate 5-cycle: labels = min id per component
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 5) for i in range(5)]
    verts = spark.createDataFrame([(i,) for i in range(301)] + [(1000 + i,) for i in range(5)], "id long")
    e = spark.createDataFrame(edges, "a long, b long")
    lab = {r["id"]: r["label"] for r in cluster.connected_components(verts, e).collect()}
    assert all(lab[i] == 0 for i in range(301))
    assert all(lab[1000 + i] == 1000 for i in range(5))


def test_eps_pairs_symmetric_and_complete(spark, pts):
    cols = ["x1", "x2", "x3"]
    pdf = pts.select("vec_id", *cols).toPandas()
    x, ids = pdf[cols].to_numpy(), pdf["vec_id"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(int(ids[i]), int(ids[j])) for i, j in zip(*np.where(d <= 0.1))}
    got = {(r["a"], r["b"]) for r in neighbors.eps_pairs(pts, "vec_id", cols, 0.1).collect()}
    assert got == want


def test_dbscan_with_a_hot_group_of_copies(spark):
    # a third of the rows are copies of one point: result must equal the point-level brute force
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * 0.5
    rows = [(i, float(x[i, 0]), float(x[i, 1])) for i in range(60)] + [(100 + i, 0.1, 0.2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    eps, ms = 0.3, 4
    ids = np.array([r[0] for r in rows])
    xy = np.array([[r[1], r[2]] for r in rows])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    adj = d <= eps
    core = adj.sum(1) >= ms
    lab = {}
    for i in np.argsort(ids):
        if core[i] and ids[i] not in lab:
            stack, comp, seen = [i], [], {i}
            while stack:
                j = stack.pop()
                comp.append(j)
                for t in np.where(adj[j] & core)[0]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            m = min(ids[j] for j in comp)
            for j in comp:
                lab[ids[j]] = m
    for i in range(len(ids)):
        if not core[i]:
            c = [lab[ids[j]] for j in np.where(adj[i] & core)[0]]
            lab[ids[i]] = min(c) if c else -1
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", ["a", "b"], eps=eps, min_samples=ms).collect()}
    assert got == lab


def test_components_of_a_path_whose_smallest_ids_are_its_ends(spark):
    n = 260
    ids = [0, *range(2, n), 1]
    verts = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    lab = {r["id"]: r["label"] for r in cluster.connected_components(verts, e).collect()}
    assert lab == {i: 0 for i in range(n)}


def test_knn_with_a_constant_grid_column_and_a_far_query_loses_no_query(spark):
    ref = spark.createDataFrame([(i, 1.0, float(i)) for i in range(100)], "id long, c double, v double")
    q = spark.createDataFrame([(1000, 1.0, 50.2), (1001, 1e6, -1e9)], "id long, c double, v double")
    got = neighbors.knn_join(q, ref, "id", "id", ["c", "v"], k=5).collect()
    by = {i: [r["r_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["q_id"] == i] for i in (1000, 1001)}
    assert by == {1000: [50, 51, 49, 52, 48], 1001: [0, 1, 2, 3, 4]}


def test_knn_impute_without_a_complete_column(spark):
    t = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, None), (3, None, 30.0), (4, 4.0, 40.0)], "id long, a double, b double")
    out = {r["id"]: r for r in neighbors.knn_impute(t, t, "id", ["a", "b"], k=1).collect()}
    assert out[2]["b"] == 10.0 and out[3]["a"] == 4.0


def test_silhouette_of_more_rows_than_a_block(spark, monkeypatch):
    import numpy as np
    from riskframe.operators import cluster
    r = np.random.default_rng(4)
    lab = np.r_[np.full(700, -1), np.arange(260) // 13, [99]]
    x = r.normal(size=(len(lab), 3)) + lab[:, None] % 7
    x[5:9] = x[5]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        mean = {c: d[i, lab == c].sum() / max((lab == c).sum() - (c == lab[i]), 1) for c in set(lab.tolist())}
        a, b = mean.pop(lab[i]), min(v for c, v in mean.items() if c != lab[i])
        want.append((b - a) / max(a, b) if (lab == lab[i]).sum() > 1 and max(a, b) > 0 else 0.0)
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, lab))],
                               "id long, x double, y double, z double, c int").repartition(5)
    for block in (8192, 100):
        monkeypatch.setattr(cluster, "BLOCK", block)
        assert abs(cluster.silhouette_exact(df, "id", ["x", "y", "z"], "c") - np.mean(want)) < 1e-9
    assert np.isnan(cluster.silhouette_exact(df.where("c = 99"), "id", ["x", "y", "z"], "c"))


def test_silhouette_queries_take_all_rows(spark, monkeypatch):
    from riskframe.operators import cluster
    from riskframe.plans import catalog
    monkeypatch.setattr(cluster, "downsample", lambda *a, **b: 1 / 0)
    assert len(catalog.q_silhouette_labels(spark, "/root/testdata/sf0.001").collect()) == 1


def test_cells_hold_rows_that_lack_the_same_columns(spark):
    from riskframe.operators.metric_index import MetricIndex
    r = np.random.default_rng(8)
    x = r.integers(0, 40, size=(900, 3)).astype(float)
    x[r.random(900) < 0.2, 1] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               "id long, a double, b double, c double")
    index = MetricIndex(df, "id", ["a", "b", "c"], "nan_euclidean", cell_rows=20)
    whole = (index.cells.present == index.cells.rows[:, None]) | (index.cells.present == 0)
    assert whole.all() and len(index.numbers) > 20  # so a box holds for all its rows
    out = {q["id"]: q for q in neighbors.knn_impute(df, df, "id", ["a", "b", "c"], k=5, cell_rows=20).collect()}
    for i in np.flatnonzero(np.isnan(x[:, 1])):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        d = np.sqrt(3 / both.sum(1) * (np.where(both, x - x[i], 0) ** 2).sum(1))
        donors = sorted((j for j in range(900) if not np.isnan(x[j, 1])), key=lambda j: (d[j], j))
        assert abs(out[int(i)]["b"] - np.mean([x[j, 1] for j in donors[:5]])) < 1e-9


def test_range_join_gives_back_bounded_groups(spark, monkeypatch):
    from riskframe.operators import metric_index
    real, most = metric_index.MetricIndex._against, []
    monkeypatch.setattr(metric_index.MetricIndex, "_against", lambda self, *a: most.append(a[4]) or real(self, *a))
    df = spark.range(3000).selectExpr("id", "double(id % 7) as a")
    assert neighbors.eps_pairs(df, "id", ["a"], 0.5).count() == sum(n * n for n in (429, 429, 429, 429, 428, 428, 428))
    assert most[0][0] * most[0][1] <= 1 << 21


def test_a_query_travels_to_blocks_of_cells(spark, monkeypatch):
    from riskframe.operators import metric_index
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(1500, 8)), 2) + np.array([1e5, 0, 0, 0, 0, 0, 0, 0])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"x{c} double" for c in range(8)))
    sent, write = [], metric_index.materialize

    def counted(t, tag):
        t = write(t, tag)
        if tag == "metric-asked":
            there = t.drop("q_id", "q", "wants", "thetas").columns[0]
            sent.append(t.selectExpr(f"sum(size({there}))").first()[0])
        return t

    monkeypatch.setattr(metric_index, "materialize", counted)
    got = neighbors.knn_join(df, df, "id", "id", [f"x{c}" for c in range(8)], k=4, exclude_self=True, cell_rows=5).collect()
    d = metric_index.distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), n + 1): d[i, j] for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(g["q_id"], g["r_id"], g["rank"]): g["dist"] for g in got} == want
    # 300 cells, of which most are within reach of most queries
    assert len(sent) == 2 and max(sent) <= 8 * len(x)


@pytest.mark.parametrize("scale", [1e-20, 1e-3, 1.0, 1e12])
def test_the_single_precision_sieve_loses_no_row(scale):
    from riskframe.operators.metric_index import _Screen, distances
    r = np.random.default_rng(4)
    x, q = (r.normal(size=(400, 6)) + 50) * scale, (r.normal(size=(70, 6)) + 51) * scale
    x[3, 2] = np.inf
    d = distances(q, x, "euclidean")
    limit = np.partition(d, 7, axis=1)[:, 7] ** 2
    found = _Screen(x, "euclidean").near(q, limit)
    if found is not None:
        assert set(zip(*np.nonzero(d ** 2 <= limit[:, None]))) <= set(zip(*found)) and len(found[0]) < 12 * len(q)
    assert (found is None) == (scale in (1e-20,))


def _partial_case(x, q, wants, thetas, k, exclude_self=False):
    """What ``_nearest_partial`` gives for these rows, and all distances with the rows' order in them."""
    import pandas as pd
    from riskframe.operators import metric_index
    r_ids = np.random.default_rng(0).permutation(len(x)) * 3
    refs = pd.DataFrame({"r_id": r_ids, "x": list(x), "bit": 0})
    asked = pd.DataFrame({"q_id": np.arange(len(q)) * 3, "q": list(q), "wants": wants, "thetas": thetas, "mask": 1})
    got = metric_index._nearest_partial(k, exclude_self, x.shape[1])(asked, refs)
    d, want = metric_index.distances(q, x, "nan_euclidean"), {}
    for i in range(len(q)):
        for w, theta in zip(wants[i], thetas[i]):
            ok = (d[i] <= theta) & (d[i] < np.inf) & (~np.isnan(x[:, w]) if w >= 0 else True) & (r_ids != 3 * i if exclude_self else True)
            for j in sorted(np.flatnonzero(ok), key=lambda j: (d[i, j], r_ids[j]))[:k]:
                want[3 * i, w, r_ids[j]] = (d[i, j], x[j, w] if w >= 0 else None)
    out = {(g.q_id, g.want, g.r_id): (g.dist, g.value if g.want >= 0 else None) for g in got.itertuples()}
    return out, want


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_rows_with_missing_values_match_brute_force(exclude_self):
    r = np.random.default_rng(12)
    x = np.round(r.normal(size=(2600, 5)) * [90, 30, 3, 1, 1], 1)
    x[r.random(x.shape) < [0.1, 0.2, 0.02, 0.0, 0.3]] = np.nan
    x[7, 0], x[8, 1], x[9, 0] = np.inf, -np.inf, np.inf
    x[100:160] = x[100]
    q = x[r.integers(0, len(x), 420)].copy()
    q[r.random(q.shape) < [0.3, 0.1, 0.0, 0.02, 0.02]] = np.nan
    q[3], q[4] = np.nan, [np.inf, 1, 1, 1, 1]
    wants = [np.r_[np.flatnonzero(np.isnan(v)), -1][:2].astype(int) for v in q]
    thetas = [np.where(r.random(len(w)) < 0.5, np.inf, r.choice([0.0, 2.0, 40.0])) for w in wants]
    got, want = _partial_case(x, q, wants, thetas, 4, exclude_self)
    assert got == want and len(want) > 1000


def test_a_query_that_lacks_a_column_is_compared_with_few_rows(monkeypatch):
    # the widest column is the one that a third of the queries lack
    from riskframe.operators import halvings
    r = np.random.default_rng(13)
    x = r.integers(0, [400, 140, 110, 50], size=(20000, 4)).astype(float)
    x[r.random(len(x)) < 0.04, 0] = np.nan
    q = r.integers(0, [400, 140, 110, 50], size=(900, 4)).astype(float)
    lack = np.arange(900) % 3
    q[np.arange(900), lack] = np.nan
    compared, real = [], halvings._Asked._squares
    monkeypatch.setattr(halvings._Asked, "_squares", lambda self, i, leaf: compared.append(real(self, i, leaf)) or compared[-1])
    got, want = _partial_case(x, q, [np.array([w]) for w in lack], [np.array([np.inf])] * 900, 5)
    assert got == want
    assert sum(c.size for c in compared) < 0.05 * q.shape[0] * x.shape[0]


def test_rows_that_lack_rare_columns_do_not_widen_other_cells(spark):
    from riskframe.operators.metric_index import MetricIndex
    r = np.random.default_rng(14)
    x = r.normal(size=(6000, 3))
    x[::1500, 1:] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               "id long, a double, b double, c double")
    index = MetricIndex(df, "id", ["a", "b", "c"], "nan_euclidean", cell_rows=500)
    whole = (index.cells.present == index.cells.rows[:, None]).all(axis=1)
    assert index.cells.rows[~whole].sum() == 4 and len(whole) > 6


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("eps", [2.0, 0.0, 5.0, 0.1 + 0.2, 1e9, -1.0])
def test_counts_within_a_distance_match_all_pairs(metric, eps):
    from riskframe.operators import metric_index, range_counts
    r = np.random.default_rng(15)
    a, b = np.round(r.normal(size=(700, 4)) * 1.5), np.round(r.normal(size=(5000, 4)) * 1.5)  # many pairs exactly at the distance
    a[:200] = np.round(r.normal(size=(200, 4)), 1)
    b[100:2100], a[300:350] = b[100], b[100] + 40
    for inf in (False, True):
        if inf:
            b[7, 1], a[9, 1] = np.inf, np.inf
        close = metric_index.distances(a, b, metric) <= eps
        ns, ms = range_counts.count_within(a, b, eps, metric)
        assert (ns == close.sum(axis=1)).all() and (ms == close.sum(axis=0)).all()


def test_a_range_join_that_counts_makes_no_row_for_a_pair(spark, monkeypatch):
    from riskframe.operators import range_counts
    monkeypatch.setattr(range_counts, "LEAST", 100)
    df = spark.range(3000).selectExpr("id", "double(id % 7) as a", "double(if(id % 500 = 0, null, int(id % 11))) as b")
    by = {}
    for r in neighbors.eps_pairs(df, "id", ["a", "b"], 1.0).groupBy("a").count().collect():
        by[r["a"]] = r["count"]
    parts = neighbors.eps_pairs(df, "id", ["a", "b"], 1.0, counted=True)
    got = parts.collect()
    sums = {}
    for r in got:
        sums[r["a"]] = sums.get(r["a"], 0) + r["n"]
    assert sums == by and len(by) == 2994
    assert len(got) < sum(by.values()) / 4
    assert neighbors.eps_pairs(df.where("id < 0"), "id", ["a", "b"], 1.0, counted=True).count() == 0
    # a hot value is cut into several parts, keys that come twice count twice, no key is lost
    hot = spark.range(5000).selectExpr("if(id % 2 = 0, null, 9007199254740993 + id div 2) as id", "1.0 as a")
    got = {r["a"]: r["n"] for r in neighbors.eps_pairs(hot, "id", ["a"], 0.5, counted=True).groupBy("a").sum("n").toDF("a", "n").collect()}
    assert got.pop(None) == 2500 * 5000 and len(got) == 2500 and set(got.values()) == {5000} and min(got) == 9007199254740993
