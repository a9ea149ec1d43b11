"""Connected components of an edge table by alternating large-star / small-star.

Every round is two grouped minima and two equi-joins; the number of rounds is
logarithmic in the graph, whatever the order of the ids, and the loop runs until
the edge set is a forest of stars (it raises if that never happens, it never
returns unfinished labels). A node with very many neighbours is harmless: minima
are pre-aggregated map-side and the join back has one row per node on its small
side. Each round is written to the shared checkpoint folder, so a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialize

#: A safety bell, not a cut: 2^200 nodes would be needed to ring it.
MAX_ROUNDS = 400


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node onto the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return (both.join(low, "src").where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours (all edges point down) onto the smallest of them."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = (edges.join(low, "src").where(F.col("dst") != F.col("low"))
             .select(F.col("dst").alias("src"), F.col("low").alias("dst")))
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, label): each id that occurs in an edge with the smallest id it reaches.

    Loops and repeated edges are ignored, edges with a NULL end link nothing, an
    empty table gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = materialize(e.distinct(), "cc")  # whatever made the edges runs once
    loops = e.where("a = b").select(F.col("a").alias("id")).distinct()
    e = e.where("a != b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    e = materialize(e, "cc")
    state = _signature(e)
    for _ in range(MAX_ROUNDS):
        e = materialize(_small_star(_large_star(e)), "cc")
        now = _signature(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    stars = e.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    roots = e.select(F.col("dst").alias("id")).distinct().select("id", F.col("id").alias("label"))
    found = stars.unionByName(roots)
    return found.unionByName(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("label")))
