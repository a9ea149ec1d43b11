"""Hard negatives by a multiway hyperplane tree with sibling distance ranges (GNAT).

Vectors are quantised to whole numbers and compared by their inner product. With one more
coordinate that brings every row to the greatest norm M, a score s against a query q is the distance
sqrt(|q|^2 + M^2 - 2s), so a window of scores is an annulus around the query, and the best scores
lie on its inner rim.

The tree is built level by level. A node above ``LEAF`` rows draws candidates by hash,
keeps ``FAN`` that lie far apart as split points, and gives each row to the nearest. For
every split point and every sibling subtree it stores the least and the greatest distance from
that point to the subtree's rows. A query with its windows goes down the levels as a row of a
table; at a node, a sibling is left out for a window if, for some split point p, the distances
that the triangle inequality allows (d(q, p) and the stored range) miss the annulus. Leaves are
compared exactly.

A search has two passes. The first follows, for each window, the one child whose split point
lies closest to the annulus' inner rim; the scores found there raise the window's lower end. The second
visits every node that the narrowed annulus meets, so its result is exact. Levels, frontiers and leaves are
tables: rows of a node and queries at a node are dealt in slices of bounded size, and nothing
but counts, one norm and the depth reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import materialize

#: Split points of a node, candidates for each of them, rows of a leaf, rows or queries of a slice, levels at most.
FAN, DRAWN, LEAF, SLICE, DEPTH = 32, 3, 2048, 4096, 40
#: Scores no vector reaches; squares of norms that whole numbers in doubles, and in longs, allow.
BEYOND, EXACT, GREATEST = 1 << 62, 2.0**53, 2.0**62
#: Distances are widened by this share of the norms before something is left out.
SLACK = 1e-6

_ROW = "row long, vec_id long, label string, z array<long>, n2 long"
_QUERY = "query long, label string, z array<long>, n2 long, w array<int>, low array<long>, high array<long>"


# ------------------------------------------------------------------ distances

def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _lift(n2, m2: float) -> np.ndarray:
    """The further coordinate of rows with these squared norms."""
    return np.sqrt(np.maximum(m2 - np.asarray(n2, np.float64), 0.0))


def _row_distances(a: np.ndarray, b: np.ndarray, m2: float) -> np.ndarray:
    """Distances between rows of the tree, with their further coordinate."""
    up = np.outer(_lift((a * a).sum(axis=1), m2), _lift((b * b).sum(axis=1), m2))
    return np.sqrt(np.maximum(2.0 * (m2 - a @ b.T - up), 0.0))


def _radius(score, q2, m2: float) -> np.ndarray:
    """Distance at which a row has this score against a query of squared norm ``q2``."""
    return np.sqrt(np.maximum(np.asarray(q2, np.float64) + m2 - 2.0 * np.asarray(score, np.float64), 0.0))


def far_apart(points: np.ndarray, most: int, m2: float) -> list[int]:
    """Numbers of at most ``most`` different rows: the first, then again and again that farthest from those taken."""
    taken, closest = [0], _row_distances(points, points[:1], m2)[:, 0]
    while len(taken) < most:
        k = int(np.argmax(closest))
        if closest[k] <= SLACK * np.sqrt(m2):
            break
        taken.append(k)
        closest = np.minimum(closest, _row_distances(points, points[k:k + 1], m2)[:, 0])
    return taken


def reached(to_points: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray,
            slack: np.ndarray) -> np.ndarray:
    """(queries, children): whether the annulus [inner, outer] around a query can hold rows of a child.

    ``to_points`` has the queries' distances to the split points, ``low`` and ``high`` (children,
    points) the ranges of the children's rows."""
    d, a, b = to_points[:, None, :], low[None], high[None]
    least = np.maximum(np.maximum(d - b, a - d), 0.0).max(axis=2)
    most = (d + b).min(axis=2)
    return (least <= (outer + slack)[:, None]) & (most >= (inner - slack)[:, None])


# ------------------------------------------------------------------ tree

def _slices(count: Column, size: int) -> Column:
    return F.ceil(count / F.lit(size)).cast("int")


def _choose(fan: int, m2: float):
    def run(batches):
        for b in batches:
            points = [[list(p[k]) for k in far_apart(_matrix(p), fan, m2)] for p in b["drawn"]]
            yield pd.DataFrame({"node": b["node"], "slices": b["slices"], "points": points})
    return run


def _divide(m2: float):
    def run(rows: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        d = _row_distances(_matrix(rows["z"]), _matrix(node["points"].iloc[0]), m2)
        child = d.argmin(axis=1)
        out = rows[["row", "vec_id", "label", "z", "n2"]].astype({"row": "Int64", "vec_id": "Int64", "n2": "Int64"})
        out = out.assign(parent=rows["node"], child=child, up=rows["n"], low=None, high=None)
        ranges = [(rows["node"].iloc[0], int(c), d[child == c].min(axis=0), d[child == c].max(axis=0)) for c in np.unique(child)]
        notes = pd.DataFrame(ranges, columns=["parent", "child", "low", "high"])
        for c, kind in (("row", "Int64"), ("vec_id", "Int64"), ("n2", "Int64"), ("up", "Int64")):
            notes[c] = pd.array([None] * len(notes), kind)
        notes["label"] = notes["z"] = None
        cols = ["row", "vec_id", "label", "z", "n2", "parent", "child", "up", "low", "high"]
        return pd.concat([out[cols].astype({"up": "Int64"}), notes[cols]], ignore_index=True)
    return run


def _ranges(notes: DataFrame) -> DataFrame:
    """One row per node: its children's numbers and their ranges to all split points."""
    each = notes.select("parent", "child", F.posexplode(F.arrays_zip("low", "high")).alias("p", "r"))
    each = each.groupBy("parent", "child", "p").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    each = each.groupBy("parent", "child").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("r"))
    each = each.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("child", "r"))).alias("c"))
    pick = lambda name: F.transform("c", lambda x: F.transform(x["r"], lambda y: y[name]))
    return each.select(F.col("parent").alias("node"), F.col("c.child").alias("children"), pick("low").alias("low"), pick("high").alias("high"))


class Tree:
    """Inner nodes (node, points, children, low, high) and leaves (node and rows) as written tables."""

    def __init__(self, rows: DataFrame, m2: float, fan: int, leaf: int) -> None:
        self.m2, self.leaf, self.depth = m2, leaf, 0
        level = rows.withColumn("node", F.size("z").cast("string")).withColumn("up", F.lit(None).cast("long"))
        inner, leaves = [], []
        while True:
            sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up"))
            # a node whose rows all came to one child holds nothing that could be parted
            parts = (F.col("n") > leaf) & (F.coalesce(F.col("n") < F.col("up"), F.lit(True))) & F.lit(self.depth < DEPTH)
            sizes = materialize(sizes.select("node", "n", parts.alias("parts"), _slices(F.col("n"), SLICE).alias("slices")), "gnat-sizes")
            sized = level.drop("up").join(sizes, "node")
            leaves.append(sized.where(~F.col("parts")).select("node", *_names(_ROW)))
            if sizes.where("parts").isEmpty():
                break
            draw = F.xxhash64("row", F.lit(self.depth))
            drawn = sized.where("parts").select("node", "slices", "z", draw.alias("draw"))
            drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("draw"))).where(F.col("k") <= DRAWN * fan)
            drawn = drawn.groupBy("node", "slices").agg(F.array_sort(F.collect_set("z")).alias("drawn"))
            points = materialize(drawn.mapInPandas(_choose(fan, m2), "node string, slices int, points array<array<long>>"), "gnat-points")
            own = sized.where("parts").withColumn("slice", F.expr("cast(pmod(xxhash64(row, 3), slices) as int)"))
            each = points.select("node", "points", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
            divided = own.groupBy("node", "slice").cogroup(each.groupBy("node", "slice")).applyInPandas(
                _divide(m2), _ROW + ", parent string, child int, up long, low array<double>, high array<double>")
            divided = materialize(divided, "gnat-level")
            inner.append(_ranges(divided.where("row is null")).join(points.select("node", "points"), "node"))
            level = divided.where("row is not null").select(F.concat_ws(".", "parent", "child").alias("node"), "up", *_names(_ROW))
            self.depth += 1
        self.leaves = materialize(_union(leaves), "gnat-leaves")
        self.inner = materialize(_union(inner), "gnat-nodes") if inner else None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ search

def _descend(m2: float, first: bool):
    """Queries at a node go on to its children: per window the one at the rim (``first``), or all that the annulus meets."""
    cols = [*_names(_QUERY), "node"]

    def run(queries: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(node):
            return pd.DataFrame(columns=cols)
        at = node.iloc[0]
        children, points = np.asarray(at["children"]), _matrix(at["points"])
        low, high = _matrix(at["low"]), _matrix(at["high"])
        q2 = queries["n2"].to_numpy(np.float64)
        own = _matrix(queries["z"])
        d = np.sqrt(np.maximum(q2[:, None] + m2 - 2.0 * (own @ points.T), 0.0))
        counts = queries["w"].map(len).to_numpy()
        q = np.repeat(np.arange(len(queries)), counts)  # a line for each window
        w, lows, highs = (np.concatenate([np.asarray(v, np.int64) for v in queries[c]]) for c in ("w", "low", "high"))
        inner, outer = _radius(highs, q2[q], m2), _radius(lows, q2[q], m2)
        if first:
            go = np.zeros((len(q), len(children)), bool)
            go[np.arange(len(q)), np.abs(d[:, children][q] - inner[:, None]).argmin(axis=1)] = True
        else:
            slack = SLACK * (np.sqrt(q2[q]) + np.sqrt(m2))
            go = np.concatenate([reached(d[q[s]], low, high, inner[s], outer[s], slack[s])
                                 for s in (slice(k, k + 256) for k in range(0, len(q), 256))])
        out = []
        for c, child in enumerate(children):
            for k in np.unique(q[go[:, c]]):
                own = go[:, c] & (q == k)
                out.append((k, w[own].tolist(), lows[own].tolist(), highs[own].tolist(), f"{at['node']}.{child}"))
        got = pd.DataFrame(out, columns=["k", "w", "low", "high", "node"])
        base = queries[["query", "label", "z", "n2"]].iloc[got["k"].to_numpy(int)].reset_index(drop=True)
        return pd.concat([base, got[["w", "low", "high", "node"]]], axis=1)[cols]

    return run


def _at_leaf(m2: float, most: int, same: bool):
    """The best ``most`` rows in each window of the queries against one leaf's rows."""
    cols = ["query", "w", "row", "vec_id", "score"]
    kind = np.float64 if m2 < EXACT else np.int64

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            z = np.array([np.asarray(v) for v in rows["z"]]).astype(kind)
            ids, numbers, labels = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy()
            order = np.lexsort((numbers, ids))  # then a stable sort by score breaks ties by id
            z, ids, numbers, labels = z[order], ids[order], numbers[order], labels[order]
            for k in range(0, len(queries), 256):
                part = queries.iloc[k:k + 256]
                scores = (np.array([np.asarray(v) for v in part["z"]]).astype(kind) @ z.T).astype(np.int64)
                for s, query, label, w, low, high in zip(scores, part["query"], part["label"], part["w"], part["low"], part["high"]):
                    side = (labels == label) == same
                    side &= numbers != query
                    for number, a, b in zip(w, low, high):
                        at = np.flatnonzero(side & (s >= a) & (s <= b))
                        if len(at) > most:  # all that tie with the last one stay for the sort
                            at = at[s[at] >= np.partition(s[at], len(at) - most)[len(at) - most]]
                        at = at[np.argsort(-s[at], kind="stable")][:most]
                        out += zip([query] * len(at), [number] * len(at), numbers[at], ids[at], s[at])
        return pd.DataFrame(out, columns=cols)

    return run


def _dealt(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Add ``slice`` in 0 .. ``slices`` - 1, where ``counts`` has the node's number of slices."""
    return df.join(counts, "node").withColumn("slice", F.expr(f"cast(pmod(xxhash64({key}, 5), slices) as int)")).drop("slices")


def _visit(tree: Tree, queries: DataFrame, first: bool, most: int, same: bool) -> DataFrame:
    """(query, w, row, vec_id, score): up to ``most`` rows of each window from every leaf visited."""
    front = queries.withColumn("node", F.size("z").cast("string"))
    fronts = [front]
    per_node = lambda df: df.groupBy("node").agg(_slices(F.count(F.lit(1)), SLICE).alias("slices"))
    for _ in range(tree.depth):
        here = front.join(tree.inner.select("node"), "node", "left_semi")
        counts = materialize(per_node(here), "gnat-counts")
        nodes = tree.inner.join(counts, "node").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).drop("slices")
        front = _dealt(here, counts, "query").groupBy("node", "slice").cogroup(nodes.groupBy("node", "slice")).applyInPandas(
            _descend(tree.m2, first), _QUERY + ", node string")
        front = materialize(front, "gnat-front")
        fronts.append(front)
    # leaves: rows in blocks (one, but for nodes that can't be parted) against queries in slices
    blocks = tree.leaves.groupBy("node").agg(_slices(F.count(F.lit(1)), tree.leaf).alias("blocks"))
    here = _union(fronts).join(blocks, "node")
    counts = materialize(per_node(here), "gnat-counts")
    asked = _dealt(here, counts, "query").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = tree.leaves.join(counts, "node").join(blocks, "node")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(row, 9), blocks) as int)"))
    rows = rows.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    keys = ["node", "slice", "block"]
    asked, rows = asked.select(*keys, *_names(_QUERY)), rows.select(*keys, *_names(_ROW))
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(
        _at_leaf(tree.m2, most, same), "query long, w int, row long, vec_id long, score long")


def search(tree: Tree, queries: DataFrame, most: int, same: bool) -> DataFrame:
    """(query, w, rank, row, vec_id, score): in each window [low, high] of each query the ``most`` rows with the
    highest scores (ties: smaller vec_id) of the query's label (``same``) or of other labels."""
    best = Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id", "row")
    near = _visit(tree, queries, True, most, same)
    kth = (near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
           .groupBy("query", "w").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).alias("kth")))
    kth = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("found"))
    raised = F.transform(F.arrays_zip("w", "low"), lambda x: F.greatest(x["low"], F.col("found")[x["w"]]))
    queries = queries.join(kth, "query", "left").withColumn("low", F.coalesce(raised, "low")).drop("found")
    found = _visit(tree, materialize(queries, "gnat-queries"), False, most, same)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


# ------------------------------------------------------------------ operator

def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, greatest: int = 90,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   fan: int = FAN, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is from
    ``least`` to ``greatest`` percent of the positive's.

    A score is the inner product of floor(scale * component), in whole numbers; higher scores come first, ties
    by smaller id. ``anchor`` is a condition on the columns of ``vectors``.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.
    Vectors of different lengths are not compared. Rows that repeat an id are rows of
    their own, as positives, negatives and anchors (an anchor is no positive of itself); rows that tie in id as well
    come in any order. A positive with a negative score has no negatives, one with score 0 those with score 0.
    Components so large that a score may not fit a long raise ValueError. An empty table, or one without
    anchors, gives an empty result; other columns are read by ``anchor`` alone, whatever their names.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.floor(x * F.lit(float(scale))).cast("double") * F.floor(x * F.lit(float(scale))).cast("double"))
    rows = materialize(rows.select("vec_id", "label", "anchor", scaled.alias("z"), size.alias("n2"))
                       .withColumn("row", F.monotonically_increasing_id()), "gnat-rows")  # numbers as written
    m2 = rows.agg(F.max("n2")).first()[0] or 0.0
    if m2 >= GREATEST:
        raise ValueError(f"components of up to {m2 ** 0.5:.3g} after scaling: their scores may not fit a long")
    rows = rows.withColumn("n2", F.col("n2").cast("long"))
    # of equal vectors of a label only the first can be among those returned
    copies = Window.partitionBy("label", "k1", "k2").orderBy("vec_id", "row")
    held = (rows.withColumn("k1", F.xxhash64("z")).withColumn("k2", F.xxhash64(F.lit(7), "z"))
            .withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)))
    tree = Tree(held.select(*_names(_ROW)), m2, fan, leaf)
    asked = rows.where("anchor").select(F.col("row").alias("query"), "vec_id", "label", "z", "n2")
    one = lambda x, kind: F.array(F.lit(x).cast(kind))
    queries = asked.select("query", "label", "z", "n2", one(0, "int").alias("w"), one(-BEYOND, "long").alias("low"), one(BEYOND, "long").alias("high"))
    own = search(tree, queries, positives, True).select(
        "query", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = materialize(own.where("positive_score >= 0"), "gnat-positives")
    window = F.struct("w", F.expr(f"({least} * positive_score + 99) div 100").alias("low"),
                      F.expr(f"({greatest} * positive_score) div 100").alias("high"))
    windows = own.groupBy("query").agg(F.array_sort(F.collect_list(window)).alias("ws"))
    queries = asked.join(windows, "query").select(
        "query", "label", "z", "n2", F.col("ws.w").alias("w"), F.col("ws.low").alias("low"), F.col("ws.high").alias("high"))
    found = search(tree, materialize(queries, "gnat-queries"), negatives, False)
    out = found.join(own, ["query", "w"]).join(asked.select("query", F.col("vec_id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))
