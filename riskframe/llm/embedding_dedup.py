"""Near-duplicate vectors by a pivot-permutation index.

Pivots are chosen from a bounded sample of the vectors so that none is close to another:
a group of near copies, however large, owns few of them, and its members order the other
pivots alike. Every vector is described by its
``prefix`` nearest pivots in order, and posted, within its label, to the inverted list
of each of them. Two vectors meet in a list; they are candidates when they share at
least ``shared`` pivots of their prefixes, and each such pair is handled once, in the list of the
lowest pivot they share. Links are verified by their cosine in double precision.
Lists are compared block by block with numpy inside tasks, which give back only the
number of links per vector and a spanning forest, never the pairs; lists above ``LIST``
rows are cut into slices, each pair of slices a task's group of its own.
Equal vectors of a label are one node that carries its number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize
from riskframe.llm.simhash import _roots
from riskframe.operators.components import component_labels

#: Pivots (from a bounded sample of the distinct vectors), length of the prefixes, pivots a candidate shares.
PIVOTS, PREFIX, SHARED = 128, 8, 3
#: Distinct vectors the pivots are chosen from, and numbers they may hold in all; cosines that two pivots stay below:
#: the first with which there are enough pivots, else that with most.
SAMPLE, SAMPLE_NUMBERS, SPREAD = 4096, 1 << 20, (0.5, 0.65, 0.8, 0.9)
#: Rounding of a block's cosines; pairs closer to the threshold are computed one by one.
EDGE = 1e-9
#: Rows of an inverted list before it is cut into slices; rows of a block.
LIST, BLOCK = 8_000, 1024


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_pivots(units: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows, taken in order, none too close to one taken before."""
    best = units[:0]
    for limit in SPREAD:
        taken, closest = [], np.full(len(units), -2.0)
        while len(taken) < most and (closest < limit).any():
            taken.append(int(np.argmax(closest < limit)))
            closest = np.maximum(closest, units @ units[taken[-1]])
            closest[taken[-1]] = 2.0
        if len(taken) > len(best):
            best = units[taken]
        if len(best) == most:
            break
    return best


def pivot_prefix(units: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest ``length`` pivots of each row, nearest first (ties: lower number)."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :length]


def _bits(prefix: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(prefix), words), np.uint64)
    rows = np.arange(len(prefix))
    for k in range(prefix.shape[1]):
        out[rows, prefix[:, k] // 64] |= np.uint64(1) << (prefix[:, k] % 64).astype(np.uint64)
    return out


def _lowest_shared(both: np.ndarray) -> np.ndarray:
    """Number of the lowest set bit over the words of ``both`` (n, words); -1 if none."""
    out = np.full(len(both), -1, np.int64)
    for k in range(both.shape[1] - 1, -1, -1):
        w = both[:, k]
        low = np.bitwise_count((w & (~w + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out = np.where(w != 0, 64 * k + low, out)
    return out


def list_links(units: np.ndarray, bits: np.ndarray, copies: np.ndarray, pivot: int, shared: int, least: float,
               slices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links per row, weighted by copies; root per row) over one inverted list."""
    n = len(units)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            ra, rb = slice(a, min(a + BLOCK, n)), slice(b, min(b + BLOCK, n))
            cosine = units[ra] @ units[rb].T
            mask = cosine >= least - EDGE
            if a == b:
                mask = np.triu(mask, 1)
            if slices is not None:
                mask &= slices[ra, None] != slices[None, rb]
            i, j = np.nonzero(mask)
            near = cosine[i, j] >= least + EDGE
            i, j = i + a, j + b
            both = bits[i] & bits[j]
            own = (np.bitwise_count(both).sum(axis=1) >= shared) & (_lowest_shared(both) == pivot)
            i, j, near = i[own], j[own], near[own]
            edge = np.flatnonzero(~near)
            near[edge] = np.einsum("ij,ij->i", units[i[edge]], units[j[edge]]) >= least
            i, j = i[near], j[near]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):  # hook roots onto smaller roots until both ends of all links agree
                x, y = parent[i], parent[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                parent = _roots(parent)
    return links, parent


def _compare(shared: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve() -> pd.DataFrame:
            p = pd.concat(held, ignore_index=True)
            units, bits = np.array(p["unit"].tolist()), np.array(p["bits"].tolist(), np.int64).view(np.uint64)
            part = p["part"].to_numpy()
            cut = None if p["pair"].iloc[0] < 0 or (part == part[0]).all() else part
            links, root = list_links(units, bits, p["copies"].to_numpy(), int(p["pivot"].iloc[0]), shared, least, cut)
            ids = p["node"].to_numpy()
            out = pd.DataFrame({"node": ids, "root": ids[root], "links": links})
            return out[(out["links"] > 0) | (out["node"] != out["root"])]

        last = None
        for b in batches:
            for key, g in b.groupby(["label", "pivot", "pair"], sort=False):
                if held and key != last:
                    yield solve()
                    held.clear()
                held.append(g)
                last = key
        if held:
            yield solve()

    return run


def _described(nodes: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    words = -(-len(pivots) // 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                p = b.iloc[at:at + 2000]
                units = _unit(p["vector"])
                order = pivot_prefix(units, pivots, prefix)
                yield pd.DataFrame({"label": p["label"], "node": p["node"], "copies": p["copies"], "unit": list(units),
                                    "prefix": list(order), "bits": list(_bits(order, words).view(np.int64))})

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "node", "copies", "vector").mapInPandas(
        run, f"label {label}, node long, copies long, unit array<double>, prefix array<int>, bits array<long>")


def embedding_components(vectors: DataFrame, least: float = 0.93, pivots: int = PIVOTS, prefix: int = PREFIX,
                         shared: int = SHARED, id_col: str = "vec_id", vector_col: str = "embedding",
                         label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: vectors of one label whose cosine is ``least`` or
    more are linked if the index finds them; no others are.

    Null, empty and zero vectors, those with a null or non-finite component, and rows with a null label or id link
    with nothing: no links, their own component. Vectors of different lengths never link. Rows
    that repeat a vector in a label link with each other; rows that repeat an id are counted as
    separate vectors, with the same component. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    # a row's vector is known by 128 bits of its values from here on
    key = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(7), "vector").alias("k2")]
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    slim = materialize(rows.select("vec_id", "label", "fine", F.size("vector").alias("dim"), *key), "vectors")
    nodes = (rows.where("fine").select("label", F.size("vector").alias("dim"), *key, "vec_id", "vector")
             .groupBy("label", "dim", "k1", "k2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"),
                                                     F.first("vector").alias("vector")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # numbers as written
    found = spark.createDataFrame([], "node long, root long, links long")
    for (dim,) in nodes.select("dim").distinct().collect():  # as many as there are vector lengths
        own = nodes.where(F.col("dim") == dim)
        size = max(pivots, min(SAMPLE, SAMPLE_NUMBERS // dim))
        draw = F.xxhash64("k1", F.lit("pivot"))
        share = 2 * size / own.count()  # some more than needed, so that partitions pass on few rows
        drawn = own.where(draw < F.lit(int(share * 2**64) - 2**63)) if share < 1 else own
        sample = drawn.orderBy(draw, "k2", "label").limit(size).select("vector").collect()
        units = spread_pivots(_unit([r[0] for r in sample]), pivots)
        k = min(prefix, len(units))
        described = materialize(_described(own, units, k), "vector-index")
        posted = described.withColumn("pivot", F.explode("prefix")).drop("prefix")
        sizes = described.select("label", F.explode("prefix").alias("pivot")).groupBy("label", "pivot").agg(
            F.count(F.lit(1)).alias("n")).where("n > 1")
        posted = posted.join(sizes, ["label", "pivot"])
        small = posted.where(F.col("n") <= LIST).withColumn("part", F.lit(0)).withColumn("pair", F.lit(-1).cast("long"))
        large = (posted.where(F.col("n") > LIST).withColumn("s", F.ceil(F.col("n") / F.lit(LIST // 2)).cast("int"))
                 .withColumn("part", F.expr("cast(pmod(xxhash64(node, 7), s) as int)"))
                 .withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
                 .withColumn("pair", F.expr("cast(least(part, other) as long) * 1000003 + greatest(part, other)"))
                 .drop("s", "other"))
        lists = small.unionByName(large).select("label", "pivot", "pair", "part", "node", "copies", "unit", "bits")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lists = lists.repartition(n, "label", "pivot", "pair").sortWithinPartitions("label", "pivot", "pair", "node")
        found = found.unionByName(lists.mapInPandas(_compare(min(shared, k), least), "node long, root long, links long"))
    found = materialize(found, "vector-links")
    roots = component_labels(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = (nodes.drop("vector").join(links, "node", "left")
             .join(roots.select(F.col("id").alias("node"), F.col("label").alias("root")), "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    named = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(named, "root").select("label", "dim", "k1", "k2", "component_id", (
        F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("fine"))
    out = slim.join(nodes, ["label", "dim", "k1", "k2", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
