"""Density clusters (DBSCAN) over the cells of a metric index, without a table of point pairs.

Equal points are one point with a weight. Most points are settled inside their own cell:

* A cell whose box is at most ε across and that weighs ``min_samples`` or more is *dense*: all its points are core and
  linked, and none of its pairs is ever looked at.
* In another cell, points are compared with those of their slice. Those that have enough neighbours there are core;
  linked core points get a common node.
* One point of every node, and every point not yet core, is compared with the ``FIRST`` cells whose bounds are least:
  that links the nodes and finds nearly all the other core points. Points still open are compared
  with every cell whose lower bound is at most ε, so which points are core is exact.
* Of the components so far, the one with most points needs no further look: any link that is missing has an
  end outside of it. The core points outside and the points that aren't core are compared with every cell within ε that has
  core points of another component. So the components are exact too.
* A point that isn't core joins the smallest label among the core points within ε.

What is sent is the points and, for the few that their own cell doesn't settle, a row per cell near by: not the
points of all pairs of cells. A group of near copies, however many, falls into dense cells and costs the number of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.components import component_labels
from riskframe.operators.metric_index import CELL_ROWS, SLACK, STEP, TOGETHER, MetricIndex, distances, matrix
from riskframe.session import materialize

#: Points of a slice of a cell; queries of a slice; cells that a point looks into first.
SLICE, ASKED, FIRST = 2048, 8192, 16


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smaller number first) that connect what the edges (a, b) connect, fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[hung]], nodes[hung]


def _reached(near: np.ndarray) -> np.ndarray:
    """Per line of a symmetric matrix of links, the smallest line that can be reached."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] >= 0:
            continue
        label[start], front = start, np.array([start])
        while len(front):
            new = near[front].any(axis=0) & (label < 0)
            label[new], front = start, np.flatnonzero(new)
    return label


def _blocks(left: pd.DataFrame, right: pd.DataFrame, width: int, eps: float):
    """(offset, whether within ε) of blocks of left rows against all right rows."""
    x, y = matrix(left["x"], width), matrix(right["x"], width)
    step = max(1, STEP // max(len(y), 1))
    for k in range(0, len(x), step):
        yield k, distances(x[k:k + step], y, "euclidean") <= eps


def _inside(width: int, eps: float, min_samples: int):
    """Points of a slice of a cell: which are core by their neighbours in it, and the least point they are linked to there."""
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("r_id").reset_index(drop=True)
        near = np.concatenate([n for _, n in _blocks(own, own, width, eps)])
        core = near @ own["w"].to_numpy() >= min_samples
        node = own["r_id"].to_numpy().copy()
        at = np.flatnonzero(core)
        node[at] = node[at[_reached(near[np.ix_(at, at)])]]
        return own[["cell", "r_id", "x", "w"]].assign(core=core, node=node)
    return run


def _near_cells(shared, width: int, eps: float, most: int | None):
    """Gives every point (x, own) the cells that it has to be compared with: those whose lower bound is at most ε, at most
    ``most`` of them; with ``own``, its label, only cells that have core points of another."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, numbers, span = shared.value
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.iloc[at:at + TOGETHER]
                q, own = matrix(part["x"], width), part["own"].to_numpy(np.int64)
                reached, lines, found, bound = cells.reach(q, eps), [], [], []
                for k in range(0, len(reached), STEP // TOGETHER):
                    some = reached[k:k + STEP // TOGETHER]
                    far = cells.bounds(q, some)
                    go = far <= eps
                    if span is not None:
                        has, low, high = (v[some] for v in span)
                        go &= has & ((low != high) | (low != own[:, None]))
                    i, j = np.nonzero(go)
                    lines.append(i)
                    found.append(some[j])
                    bound.append(far[i, j])
                i, j, d = (np.concatenate(v) if v else np.zeros(0, int) for v in (lines, found, bound))
                order = np.lexsort((j, d, i))
                i, j = i[order], j[order]
                if most is not None:
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
                    i, j = i[keep], j[keep]
                ends = np.searchsorted(i, np.arange(1, len(part)))
                yield part.assign(cells=np.array([*np.split(numbers[j], ends), None], object)[:-1])
    return run


def _counts(width: int, eps: float):
    """Per query the weight of its neighbours among the references (``n``), and a row with ``linked`` for each node of core
    points near to it."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["q_id", "n", "node", "linked"])
        ids, w, out = left["q_id"].to_numpy(), right["w"].to_numpy(), []
        nodes, of = np.unique(right["node"].to_numpy(), return_inverse=True)
        core = right["core"].to_numpy(bool)
        for k, near in _blocks(left, right, width, eps):
            some = ids[k:k + len(near)]
            out.append(pd.DataFrame({"q_id": some, "n": near @ w, "node": 0, "linked": False}))
            i, j = np.nonzero(near[:, core])
            pair = np.unique(i * len(nodes) + of[core][j])
            out.append(pd.DataFrame({"q_id": some[pair // len(nodes)], "n": 0, "node": nodes[pair % len(nodes)], "linked": True}))
        out = pd.concat(out, ignore_index=True)
        return out[(out["n"] > 0) | out["linked"]]
    return run


def _links(width: int, eps: float):
    """(a, b, border) rows: a forest over the labels of core points, and labels next to points that aren't core."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right[right["core"].to_numpy(bool)]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["a", "b", "border"])
        a, b, here, ids = left["own"].to_numpy(), right["node"].to_numpy(), left["core"].to_numpy(bool), left["q_id"].to_numpy()
        edges, border = [], []
        for k, near in _blocks(left, right, width, eps):
            core, label = here[k:k + len(near)], a[k:k + len(near)]
            i, j = np.nonzero(near & core[:, None] & (label[:, None] != b[None, :]))
            edges.append(spanning_forest(label[i], b[j]))
            i, j = np.nonzero(near & ~core[:, None])
            border.append((ids[k + i], b[j]))
        out = []
        for pairs, kind in ((edges, False), (border, True)):
            p, q = (np.concatenate([np.asarray(e[s], np.int64) for e in pairs]) for s in (0, 1))
            p, q = spanning_forest(p, q) if not kind else np.unique(np.stack([p, q]), axis=1)
            out.append(pd.DataFrame({"a": p, "b": q, "border": kind}))
        return pd.concat(out, ignore_index=True)
    return run


def _meet(queries: DataFrame, refs: DataFrame, near, compare, out: str) -> DataFrame:
    """``compare`` of the queries (cell, q_id, x, own, core) and the references (cell, r_id, x, w, core, node) of the cells
    that ``near`` gives them, in slices."""
    cols = "q_id long, x array<double>, own long, core boolean"
    side = queries.repartitionByRange("cell", F.xxhash64("q_id")).sortWithinPartitions("cell").select("q_id", "x", "own", "core")
    asked = materialize(side.mapInPandas(near, cols + ", cells array<long>"), "density-asked")
    asked = asked.withColumn("cell", F.explode("cells")).drop("cells")
    per = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))
    counts = materialize(per(asked, ASKED, "qs").join(per(refs, SLICE, "rs"), "cell"), "density-slices")
    slice_of = lambda key, n: F.expr(f"cast(pmod(xxhash64({key}, 5), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    keys = ["cell", "a", "b"]
    left = asked.join(counts, "cell").withColumn("a", slice_of("q_id", "qs")).withColumn("b", each("rs")).drop("qs", "rs")
    right = refs.join(counts, "cell").withColumn("b", slice_of("r_id", "rs")).withColumn("a", each("qs")).drop("qs", "rs")
    return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, out), "density-met")


def density_clusters(df: DataFrame, key: str, cols: Sequence[str], eps: float = 2.0, min_samples: int = 5,
                     cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, cluster): density clusters, −1 = noise. A point is core when at least ``min_samples`` points (itself
    included) lie within ``eps``. Core points within ``eps`` of each other are in one cluster, labelled by its smallest
    core key; another point joins the smallest-labelled cluster among its core neighbours. Keys are whole numbers.

    Rows with a null or NaN among ``cols`` lie near nothing: noise. An empty table gives an empty result."""
    spark, cols, width = df.sparkSession, list(cols), len(cols)
    values = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols])
    # +0.0 makes a negative zero equal to zero
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(values, lambda v: v + F.lit(0.0)).alias("x"))
    rows = materialize(rows.select("id", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(7), "x").alias("k2")), "density-rows")
    whole = rows.where(~F.exists("x", lambda v: v.isNull()))
    groups = materialize(whole.groupBy("k1", "k2").agg(F.min("id").alias("r_id"), F.count(F.lit(1)).alias("w"), F.first("x").alias("x")),
                         "density-groups")
    index = MetricIndex(groups.select("r_id", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]), "r_id", cols, "euclidean", cell_rows)
    noise = F.lit(-1).cast("long")
    if index.empty:
        return df.select(F.col(key), noise.alias("cluster"))
    points = index.refs.join(groups.select("r_id", "w"), "r_id")
    sizes = materialize(points.groupBy("cell").agg(F.sum("w").alias("total"), F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).cast("int").alias("s"),
                                                   F.min("r_id").alias("least")), "density-sizes")
    weight = {r["cell"]: r["total"] for r in sizes.select("cell", "total").collect()}  # one row per cell
    cells, numbers = index.cells, index.numbers
    narrow = np.sqrt(((cells.high - cells.low) ** 2).sum(axis=1)) * (1 + SLACK) <= eps
    dense = [(int(c), bool(n and weight[c] >= min_samples)) for c, n in zip(numbers, narrow)]
    placed = points.join(sizes.drop("total"), "cell").join(spark.createDataFrame(dense, "cell long, dense boolean"), "cell")
    part = F.expr("cast(pmod(xxhash64(r_id, 5), s) as int)")
    kinds = "cell long, r_id long, x array<double>, w long, core boolean, node long"
    own = placed.where("not dense").withColumn("part", part).groupBy("cell", "part").applyInPandas(_inside(width, eps, min_samples), kinds)
    state = materialize(placed.where("dense").select("cell", "r_id", "x", "w", F.lit(True).alias("core"), F.col("least").alias("node"))
                        .unionByName(own), "density-own")
    met = "q_id long, n long, node long, linked boolean"

    def near(most=None, span=None):
        return _near_cells(spark.sparkContext.broadcast((cells, numbers, span)), width, eps, most)

    def grown(asked, found):
        """The state with the asked points that have neighbours enough as core points, and the links of core points found."""
        enough = found.groupBy("q_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("q_id").alias("r_id"), F.lit(True).alias("more"))
        now = materialize(state.join(enough, "r_id", "left").withColumn("core", F.col("core") | F.coalesce("more", F.lit(False))).drop("more"),
                          "density-core")
        ends = asked.select("q_id", "core").join(enough.withColumnRenamed("r_id", "q_id"), "q_id", "left").where(
            F.col("core") | F.col("more")).select("q_id")
        return now, found.where("linked").join(ends, "q_id").select(F.col("q_id").alias("a"), F.col("node").alias("b"))

    # a node is named by one of its points; a point that isn't core is its own
    ask = lambda which: which.select("cell", F.col("r_id").alias("q_id"), "x", F.col("node").alias("own"), "core")
    first = ask(state.where("not core or r_id = node"))
    state, links = grown(first, _meet(first, state, near(FIRST), _counts(width, eps), met))
    rest = ask(state.where("not core"))
    state, more = grown(rest, _meet(rest, state, near(), _counts(width, eps), met))
    alone = state.where("core").select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    labels = materialize(component_labels(links.unionByName(more).unionByName(alone), "a", "b"), "density-labels")
    state = materialize(state.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select(
        "cell", "r_id", "x", "w", "core", F.when(F.col("core"), F.col("label")).otherwise(F.col("r_id")).alias("node")), "density-state")
    largest = state.where("core").groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").first()
    if largest is None:
        return df.select(F.col(key), noise.alias("cluster"))
    span = {r["cell"]: (r["low"], r["high"]) for r in state.where("core").groupBy("cell").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).collect()}  # one row per cell
    span = np.array([int(c) in span for c in numbers]), *(np.array([span.get(int(c), (0, 0))[i] for c in numbers], np.int64) for i in (0, 1))
    outside = ask(state.where(~F.col("core") | (F.col("node") != F.lit(largest["node"]))))
    found = _meet(outside, state, near(None, span), _links(width, eps), "a long, b long, border boolean")
    nodes = state.where("core").select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    labels = component_labels(found.where("not border").select("a", "b").unionByName(nodes), "a", "b")
    border = found.where("border").select(F.col("a").alias("r_id"), F.col("b").alias("node"))
    border = border.join(labels, F.col("node") == labels["id"]).groupBy("r_id").agg(F.min("label").alias("label"))
    named_points = state.where("core").join(labels, F.col("node") == labels["id"]).select("r_id", "label").unionByName(border)
    by_group = groups.select("k1", "k2", "r_id").join(named_points, "r_id").select("k1", "k2", "label")
    out = rows.select("id", F.when(F.exists("x", lambda v: v.isNull()), F.lit(None)).otherwise(F.col("k1")).alias("k1"), "k2")
    out = out.join(by_group, ["k1", "k2"], "left").select("id", F.coalesce("label", noise).alias("cluster"))
    return out.withColumn(key, F.col("id").cast(df.schema[key].dataType)).select(key, "cluster")
