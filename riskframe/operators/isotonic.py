"""Isotonic regression as a greatest convex minorant, found range by range and merged by slopes.

Sort the distinct scores of a group and plot the running sum of the targets, S, against the running weight, W:
the increasing least-squares fit is the slope of the greatest convex minorant of that diagram.

1. The scores are cut into ranges of at most about ``RANGE`` rows. Each range is reduced, by itself, to the vertices of
   its own minorant (pool-adjacent-violators); only they can be vertices of the whole one.
2. While a group has more than ``SOLVE`` vertices left, a grid of ``SLOPES`` slopes is laid over it. For a slope s the
   whole minorant's vertex is the one with the least S − s·W, so each range gives one candidate per slope and
   a grouped minimum decides. The vertices found cut the diagram into pieces that don't depend on each other; of a
   range's vertices only those go on that lie in a piece and touch its slopes. Pieces that are still large are cut again.
3. Each piece is solved by one task, and the pieces' edges are the steps of the fit.

Steps are a table (score from, score to, value), never collected. Scores find their step by a fill along the ranges:
the last step that begins at or before them. Sums of whole numbers stay exact, as the slopes of a grid are
binary fractions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

#: Scores of a range, vertices that one task solves, slopes of a grid.
RANGE, SOLVE, SLOPES = 1 << 16, 1 << 17, 1024
#: A safety bell: each round divides the slopes by SLOPES.
MAX_ROUNDS = 40


def minorant(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Positions of the vertices of the greatest convex minorant of points with increasing ``w``; both ends belong to it,
    points inside an edge don't."""
    kept: list[int] = []
    for i in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (s[b] - s[a]) * (w[i] - w[b]) < (s[i] - s[b]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(i)
    return np.array(kept, np.int64)


def _chain(keys: list[str]):
    """The vertices of one range's minorant, with the slopes to their left and right."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p", kind="stable")
        w = np.r_[rows["w0"].iloc[0], rows["w0"].to_numpy() + rows["w"].to_numpy()]
        s = np.r_[rows["s0"].iloc[0], rows["s0"].to_numpy() + rows["s"].to_numpy()]
        at = minorant(w, s)
        slope = np.diff(s[at]) / np.diff(w[at])
        out = pd.DataFrame({"W": w[at], "S": s[at], "left": np.r_[-np.inf, slope], "right": np.r_[slope, np.inf]})
        return out.assign(**{k: rows[k].iloc[0] for k in keys}, r=rows["r"].iloc[0])[[*keys, "r", "W", "S", "left", "right"]]
    return run


def _touching(keys: list[str]):
    """For every slope of the piece's grid the range's vertex with the least S − slope·W."""
    def run(chain: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        if not len(chain) or not len(grid):
            return pd.DataFrame(columns=[*keys, "node", "k", "h", "W", "S"])
        chain = chain.sort_values("W", kind="stable")
        low, step, n = grid["low"].iloc[0], grid["step"].iloc[0], int(grid["n"].iloc[0])
        slopes = low + step * np.arange(n + 1)
        at = np.minimum(np.searchsorted(chain["right"].to_numpy(), slopes, side="left"), len(chain) - 1)
        w, s = chain["W"].to_numpy()[at], chain["S"].to_numpy()[at]
        out = pd.DataFrame({"k": np.arange(n + 1), "h": s - slopes * w, "W": w, "S": s})
        return out.assign(**{k: chain[k].iloc[0] for k in [*keys, "node"]})[[*keys, "node", "k", "h", "W", "S"]]
    return run


def _divided(keys: list[str]):
    """The range's vertices that lie inside one of the found pieces and touch its slopes, and the pieces' ends."""
    cols = [*keys, "node", "r", "W", "S", "left", "right", "low", "high"]

    def run(chain: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(chain) or not len(found):
            return pd.DataFrame(columns=cols)
        ks, w = np.asarray(found["ks"].iloc[0]), np.asarray(found["ws"].iloc[0])
        low, step = found["low"].iloc[0], found["step"].iloc[0]
        own = chain["W"].to_numpy()
        # piece j lies between the ends w[j] and w[j + 1]; its slopes are those from the last slope that touches w[j] on
        j = np.searchsorted(w, own, side="right") - 1
        inside = (j >= 0) & (j < len(w) - 1)
        j = np.clip(j, 0, len(w) - 2)
        inside &= own > w[j]
        a, b = low + step * ks[j], low + step * (ks[j] + 1)
        first, last = ks[j] < 0, ks[j] >= found["n"].iloc[0]
        a, b = np.where(first, -np.inf, a), np.where(last, np.inf, b)
        inside &= (chain["right"].to_numpy() >= a) & (chain["left"].to_numpy() <= b)
        out = chain[inside].assign(low=a[inside], high=b[inside])
        out["node"] = pd.Series([f"{n}.{x}" for n, x in zip(out["node"], j[inside])], out.index, object)
        return out[cols]
    return run


def _solve(keys: list[str]):
    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["W", "S"], kind="stable").drop_duplicates("W")
        w, s = points["W"].to_numpy(), points["S"].to_numpy()
        at = minorant(w, s)
        out = pd.DataFrame({"w0": w[at][:-1], "value": np.diff(s[at]) / np.diff(w[at])})
        return out.assign(**{k: points[k].iloc[0] for k in keys})[[*keys, "w0", "value"]]
    return run


def _same(keys: Sequence[str], a: str = "a", b: str = "b") -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


class IsotonicFit:
    """The fit of ``y`` on ``p`` per group: ``scores`` (by…, p, fitted) holds each distinct score, ``steps``
    (by…, low, high, value) the pools of scores that share a value."""

    def __init__(self, scored: DataFrame, y: str, p: str, by: Sequence[str] = (), scores_per_range: int = RANGE, solve: int = SOLVE,
                 slopes: int = SLOPES) -> None:
        self.by = list(by)
        keys = self.keys = [f"k{i}" for i in range(len(self.by))]
        v = F.col(p).cast("double")
        rows = scored.select(*[F.col(c).alias(k) for c, k in zip(self.by, keys)], v.alias("p"), F.col(y).cast("double").alias("y"))
        rows = rows.where(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull() & ~F.isnan("y"))
        g = materialize(rows.groupBy(*keys, "p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("w")), "iso-scores")
        kinds = "".join(f"{k} {g.schema[k].dataType.simpleString()}, " for k in keys)
        ranges = max(1, -(-g.count() // scores_per_range))
        g = materialize(g.repartitionByRange(ranges, *keys, "p").withColumn("r", F.spark_partition_id()), "iso-ranges")
        inside = Window.partitionBy(*keys, "r").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        g = materialize(g.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"{c}0") for c in ("s", "w")]), "iso-inside")
        # a range's total is its running sum's end: added up in another order it would not meet the next range's begin
        totals = g.groupBy(*keys, "r").agg(*[F.max_by(F.col(f"{c}0") + F.col(c), "p").alias(c) for c in ("s", "w")])
        before = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        shift = totals.select(*keys, "r", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_") for c in ("s", "w")])
        g = g.alias("a").join(shift.alias("b"), _same([*keys, "r"])).select(
            *[f"a.{k}" for k in keys], "a.r", "a.p", "a.s", "a.w", (F.col("s0") + F.col("s_")).alias("s0"), (F.col("w0") + F.col("w_")).alias("w0"))
        g = materialize(g, "iso-diagram")
        vertices = g.groupBy(*keys, "r").applyInPandas(_chain(keys), f"{kinds}r int, W double, S double, left double, right double")
        inf = F.lit(float("inf"))
        open_ = vertices.withColumn("node", F.lit("0")).withColumn("low", -inf).withColumn("high", inf)
        open_ = materialize(open_, "iso-vertices")
        done = []
        for _ in range(MAX_ROUNDS):
            sizes = open_.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                                     F.min(F.when(F.col("left") > -inf, F.col("left"))).alias("least"),
                                                     F.max(F.when(F.col("right") < inf, F.col("right"))).alias("most"))
            sizes = materialize(sizes, "iso-sizes")
            large = sizes.where(F.col("n") > solve)
            cols = [*keys, "node"]
            small = sizes.where(F.col("n") <= solve).select(*cols)
            done.append(open_.alias("a").join(small.alias("b"), _same(cols)).select("a.*"))
            if large.isEmpty():
                break
            # a grid of binary fractions over the slopes that the piece can have
            a, b = F.greatest("low", "least"), F.least("high", "most")
            width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(b - a, F.abs(a) * 1e-12, F.lit(1e-300)))))
            step = width / slopes
            grid = large.select(*cols, (F.floor(a / step) * step).alias("low"), step.alias("step"), F.lit(slopes + 1).alias("n"),
                                F.col("low").alias("from"), F.col("high").alias("to"))
            grid = materialize(grid, "iso-grid")
            ranges_of = open_.select(*cols, "r").distinct()
            per_range = grid.alias("a").join(ranges_of.alias("b"), _same(cols)).select("a.*", F.col("b.r").alias("r"))
            group = [*cols, "r"]
            touch = open_.groupBy(*group).cogroup(per_range.groupBy(*group)).applyInPandas(
                _touching(keys), f"{kinds}node string, k int, h double, W double, S double")
            best = touch.groupBy(*cols, "k").agg(F.min(F.struct("h", "W", "S")).alias("b")).select(*cols, "k", "b.W", "b.S")
            ends = open_.alias("a").join(large.alias("b"), _same(cols)).groupBy(*[F.col(f"a.{c}").alias(c) for c in cols]).agg(
                F.min(F.struct("W", "S")).alias("x"), F.max(F.struct("W", "S")).alias("y"))
            ends = ends.select(*cols, F.inline(F.array(F.struct(F.lit(-1).alias("k"), F.col("x.W").alias("W"), F.col("x.S").alias("S")),
                                                       F.struct(F.lit(slopes + 2).alias("k"), F.col("y.W").alias("W"), F.col("y.S").alias("S")))))
            cut = materialize(best.unionByName(ends).groupBy(*cols, "W").agg(F.max("k").alias("k"), F.min("S").alias("S")), "iso-cut")
            found = cut.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("W", "k", "S"))).alias("f"))
            found = found.select(*cols, F.col("f.W").alias("ws"), F.col("f.k").alias("ks"), F.col("f.S").alias("ss"))
            found = materialize(found.alias("a").join(grid.alias("b"), _same(cols)).select("a.*", "b.low", "b.step", F.lit(slopes + 1).alias("n")), "iso-found")
            each = found.alias("a").join(ranges_of.alias("b"), _same(cols)).select("a.*", F.col("b.r").alias("r"))
            kept = open_.groupBy(*group).cogroup(each.groupBy(*group)).applyInPandas(
                _divided(keys), f"{kinds}node string, r int, W double, S double, left double, right double, low double, high double")
            # the ends of the pieces belong to both neighbours
            pieces = found.select(*keys, "node", "low", "step", F.posexplode(F.arrays_zip(
                F.slice("ws", 1, F.size("ws") - 1).alias("wa"), F.slice("ws", 2, F.size("ws") - 1).alias("wb"), F.slice("ss", 1, F.size("ss") - 1).alias("sa"),
                F.slice("ss", 2, F.size("ss") - 1).alias("sb"), F.slice("ks", 1, F.size("ks") - 1).alias("k"))).alias("j", "e"))
            at = F.col("low") + F.col("step") * F.col("e.k")
            down, up = F.when(F.col("e.k") < 0, -inf).otherwise(at), F.when(F.col("e.k") > slopes, inf).otherwise(at + F.col("step"))
            pieces = pieces.select(*keys, F.concat_ws(".", "node", "j").alias("node"), F.lit(-1).alias("r"), F.inline(F.array(
                F.struct(F.col("e.wa").alias("W"), F.col("e.sa").alias("S"), (-inf).alias("left"), up.alias("right"), down.alias("low"), up.alias("high")),
                F.struct(F.col("e.wb").alias("W"), F.col("e.sb").alias("S"), down.alias("left"), inf.alias("right"), down.alias("low"), up.alias("high")))))
            open_ = materialize(kept.unionByName(pieces), "iso-open")
        else:
            raise RuntimeError("isotonic pieces did not settle")
        points = done[0]
        for part in done[1:]:
            points = points.unionByName(part)
        edges = materialize(points.groupBy(*keys, "node").applyInPandas(_solve(keys), f"{kinds}w0 double, value double"), "iso-edges")
        # a step begins at the score with its running weight; the scores after it share its value
        begun = g.alias("a").join(edges.alias("b"), _same([*keys, "w0"]), "left").select(
            *[F.col(f"a.{k}").alias(k) for k in keys], "a.r", "a.p", F.when(F.col("b.value").isNotNull(), F.struct(F.col("a.w0").alias("w0"), F.col("b.value").alias("value"))).alias("step"))
        filled = fill_forward(materialize(begun, "iso-begun"), keys, "p", "step")
        self._scores = materialize(filled.select(*keys, "p", F.col("step.w0").alias("w0"), F.col("step.value").alias("value")), "iso-fitted")
        names = [F.col(k).alias(c) for c, k in zip(self.by, keys)]
        self.scores = self._scores.select(*names, "p", F.col("value").alias("fitted"))
        self._steps = self._scores.groupBy(*keys, "w0").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.first("value").alias("value"))
        self.steps = self._steps.select(*names, "low", "high", "value")

    def apply(self, rows: DataFrame, p: str, out: str) -> DataFrame:
        return apply_steps(rows, p, out, self.steps, self.by)


def apply_steps(rows: DataFrame, p: str, out: str, steps: DataFrame, by: Sequence[str] = (), scores_per_range: int = RANGE) -> DataFrame:
    """``rows`` with ``out``: the fit whose ``steps`` (by…, low, high, value) are given, at ``p``: linear between steps and
    constant beyond the first and the last; NULL for a NULL or NaN score and for groups without a fit."""
    by = list(by)
    keys = [f"k{i}" for i in range(len(by))]
    v = F.col(p).cast("double")
    own = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("p")).where(F.col("p").isNotNull() & ~F.isnan("p")).distinct()
    named = steps.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "low", "high", "value")
    knots = named.select(*keys, F.inline(F.array(F.struct(F.col("low").alias("p"), "value"), F.struct(F.col("high").alias("p"), "value")))).distinct()
    both = own.withColumn("value", F.lit(None).cast("double")).unionByName(knots).groupBy(*keys, "p").agg(F.max("value").alias("value"))
    both = materialize(both, "iso-apply")
    ranges = max(1, -(-both.count() // scores_per_range))
    both = materialize(both.repartitionByRange(ranges, *keys, "p").withColumn("r", F.spark_partition_id()), "iso-apply-ranges")
    both = both.withColumn("knot", F.when(F.col("value").isNotNull(), F.struct("p", "value")))
    both = fill_forward(both.withColumn("after", F.col("knot")), keys, "p", "knot")
    both = fill_forward(both, keys, "p", "after", down=True)
    x0, x1, y0, y1 = (F.col(f"{c}.{n}") for n in ("p", "value") for c in ("knot", "after"))
    share = (F.col("p") - x0) / F.nullif(x1 - x0, F.lit(0.0))
    fit = F.coalesce(F.when(y0 == y1, y0).otherwise(y0 + (y1 - y0) * share), y0, y1)
    fits = both.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("p").alias("_p"), F.coalesce("value", fit).alias("_fit"))
    on = v == F.col("_p")
    for c, k in zip(by, keys):
        on = on & rows[c].eqNullSafe(F.col(f"_{k}"))
    return rows.join(fits, on, "left").select(*[rows[c] for c in rows.columns if c != out], F.col("_fit").alias(out))


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str, down: bool = False) -> DataFrame:
    """``df``, a table cut into ranges ``r`` of (keys…, ``order``), with NULLs of ``value`` filled by the last
    value before (after, if ``down``) in the group: inside the ranges first, then from range to range."""
    way = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    upto = Window.partitionBy(*keys, "r").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(value, F.last(value, ignorenulls=True).over(upto))
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys, "r").agg(
        (F.min_by if down else F.max_by)(value, order).alias("end"))
    every = df.select(*keys, "r").distinct().alias("a").join(ends.alias("b"), _same([*keys, "r"]), "left").select(*[f"a.{k}" for k in keys], "a.r", "b.end")
    before = Window.partitionBy(*keys).orderBy(way("r")).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*keys, "r", F.last("end", ignorenulls=True).over(before).alias("carry"))
    joined = df.alias("a").join(carry.alias("b"), _same([*keys, "r"]))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns if c != value], F.coalesce(F.col(f"a.{value}"), F.col("b.carry")).alias(value))


def isotonic_fit(scored: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, p, fitted): increasing least-squares fit of y on p, tied scores pooled. Rows with a NULL or NaN
    score or target are left out."""
    fit = IsotonicFit(scored, y, p, by)
    return fit.scores.select(*by, F.col("p").alias(p), "fitted")
