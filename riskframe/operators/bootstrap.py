"""Bootstrap confidence intervals for recall, ROC-AUC and average precision.

Poisson bootstrap at cell level (Chamandy et al. 2012, "Estimating uncertainty
for massive data streams"): every row gets an independent Poisson(1)
multiplicity per iteration, and the sum of c independent Poisson(1) draws is
Poisson(c). Since the metrics depend on a row only through its cell
(group, score, pred, y), one Poisson(count) draw per (iteration, cell) gives
exactly the row-level Poisson bootstrap while the work is
B × #cells — independent of the number of rows. Draws are inverse-CDF
samples of uniforms from a SplitMix64 stream seeded by a 64-bit hash of
(seed, cell), so the answer does not depend on partitioning, and they can be drawn again
rather than kept: a cell is one row, never B.

The cells are cut into ranges of the score, ``RANGE`` cells each. A first pass turns every
range into three vectors of B sums (weight, positives, predicted positives). Their running totals
over the ranges, from the top, are the offsets with which a second pass turns each range into its share of
every iteration's AUC and average precision. What is shuffled is the cells and, per range, a few
vectors of B numbers: B × cells / RANGE, not B × cells.
Iterations where the resample has a single class are skipped, as in the
reference; intervals are linear-interpolated 2.5 % / 97.5 % percentiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

N_ITERATIONS = 1000
#: Cells of a range; cells whose weights are held at a time.
RANGE, CHUNK = 1 << 15, 512


def _poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """(first k, P(X ≤ k) from there on) of a Poisson law; what lies outside is below 1e-30."""
    if rate <= 0:
        return 0, np.ones(1)
    spread = 12.0 * np.sqrt(rate) + 25
    low = max(0, int(rate - spread))
    ks = np.arange(low, int(rate + spread) + 1)
    first = -rate + low * math.log(rate) - math.lgamma(low + 1)
    steps = np.log(rate) - np.log(np.maximum(ks[1:], 1))
    return low, np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)])))


def poisson_quantile(lam: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Smallest k with P(X ≤ k) ≥ u for X ~ Poisson(lam), by inversion at every rate."""
    lam, u = np.asarray(lam, dtype=float), np.asarray(u, dtype=float)
    out = np.zeros(len(lam), dtype=np.int64)
    # one table per distinct rate (cell counts repeat a lot), then a binary search per draw
    rates, inv = np.unique(lam, return_inverse=True)
    for j, rate in enumerate(rates):
        low, cdf = _poisson_table(float(rate))
        sel = inv == j
        out[sel] = low + np.minimum(np.searchsorted(cdf, u[sel], side="left"), len(cdf) - 1)
    return out


_MASK64 = (1 << 64) - 1


def _splitmix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (Steele, Lea & Flood 2014) on uint64 arrays."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cell_weights(lam: np.ndarray, cell_hash: np.ndarray, n_iterations: int) -> list[np.ndarray]:
    """Poisson(lam) draws for iterations 0..B−1 of each cell; the uniform for
    (cell, b) is splitmix64(cell_hash + b), so draws depend only on the cell."""
    b = np.arange(n_iterations, dtype=np.uint64)
    out = []
    for lam_i, h_i in zip(lam, cell_hash):
        bits = _splitmix64(np.uint64(np.int64(h_i).astype(np.uint64)) + b)
        u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        out.append(poisson_quantile(np.full(n_iterations, lam_i), u))
    return out


def score_cells(scored: DataFrame, y: str, pred: str, p: str, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(by…, p, y, pred, c, h): rows that are alike in all that the metrics see, how many, and the hash their draws come from."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, p, y, pred]])
    cells = scored.where(F.col(p).isNotNull()).groupBy(*by, p, y, pred).agg(F.count(F.lit(1)).alias("c"))
    return cells.withColumn("h", F.xxhash64(F.lit(int(seed)), key))


def bootstrap_weights(scored: DataFrame, y: str, pred: str, p: str, by: Sequence[str] = (),
                      n_iterations: int = N_ITERATIONS, seed: int = 42) -> DataFrame:
    """(by…, p, y, pred, w array): the weights that ``bootstrap_iterations`` draws for every cell; a row per cell."""
    cells = score_cells(scored, y, pred, p, by, seed)

    @F.pandas_udf("array<long>")
    def draw(c: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(cell_weights(c.to_numpy(float), h.to_numpy(), n_iterations))

    return cells.select(*by, p, y, pred, draw("c", "h").alias("w"))


def _weights(cells: pd.DataFrame, n_iterations: int) -> np.ndarray:
    """(cells, B) weights, given or drawn."""
    if "w" in cells:
        return np.array(cells["w"].tolist(), np.float64).reshape(len(cells), n_iterations)
    return np.array(cell_weights(cells["c"].to_numpy(float), cells["h"].to_numpy(), n_iterations), np.float64).reshape(len(cells), n_iterations)


def _range_sums(n_iterations: int, keys: list[str]):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((3, n_iterations))
        for k in range(0, len(cells), CHUNK):
            part = cells.iloc[k:k + CHUNK]
            w, y, pred = _weights(part, n_iterations), part["y"].to_numpy(float), part["pred"].to_numpy(float)
            sums += np.stack([w.sum(axis=0), y @ w, (y * pred) @ w])
        return cells[[*keys, "r"]].iloc[:1].assign(cnt=[sums[0]], pos=[sums[1]], hit=[sums[2]])
    return run


def _range_areas(n_iterations: int, keys: list[str]):
    def run(cells: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("p", ascending=False, kind="stable").reset_index(drop=True)
        cnt, pos = np.array(above["cnt"].iloc[0], float), np.array(above["pos"].iloc[0], float)
        starts = np.flatnonzero(np.r_[True, np.diff(cells["p"].to_numpy()) != 0])
        auc, ap, at = np.zeros(n_iterations), np.zeros(n_iterations), 0
        while at < len(starts):  # whole scores, about CHUNK cells at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
            low, high = starts[at], starts[to] if to < len(starts) else len(cells)
            part = cells.iloc[low:high]
            w = _weights(part, n_iterations)
            per = np.add.reduceat(w, starts[at:to] - low, axis=0)
            own = np.add.reduceat(w * part["y"].to_numpy(float)[:, None], starts[at:to] - low, axis=0)
            total, hits = cnt + np.cumsum(per, axis=0), pos + np.cumsum(own, axis=0)
            auc += ((per - own) * (hits - own / 2)).sum(axis=0)
            ap += np.divide(own * hits, total, out=np.zeros_like(own), where=total > 0).sum(axis=0)
            cnt, pos, at = total[-1], hits[-1], to
        return cells[keys].iloc[:1].assign(b=[np.arange(n_iterations)], auc=[auc], ap=[ap])
    return run


def iteration_metrics(cells: DataFrame, n_iterations: int, y: str = "y", pred: str = "pred", p: str = "p", by: Sequence[str] = (),
                      cells_per_range: int = RANGE) -> DataFrame:
    """(by…, b, recall, roc_auc, pr_auc) for every iteration with both classes, from one row per cell: with ``w``, the
    weights of all iterations, or with ``c`` and ``h``, from which they are drawn."""
    by, given = list(by), "w" in cells.columns
    keys = [f"k{i}" for i in range(len(by))]
    rows = cells.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"),
                        F.col(pred).cast("int").alias("pred"), *(["w"] if given else ["c", "h"]))
    rows = materialize(rows, "boot-cells")
    ranges = max(1, -(-rows.count() // cells_per_range))
    rows = materialize(rows.repartitionByRange(ranges, *keys, "p").withColumn("r", F.spark_partition_id()), "boot-ranges")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " * bool(keys)
    vectors = "cnt array<double>, pos array<double>, hit array<double>"
    sums = materialize(rows.groupBy(*keys, "r").applyInPandas(_range_sums(n_iterations, keys), f"{kinds}r int, {vectors}"), "boot-sums")
    long = sums.select(*keys, "r", F.posexplode(F.arrays_zip("cnt", "pos", "hit")).alias("b", "v")).select(*keys, "r", "b", "v.*")
    above = Window.partitionBy(*keys, "b").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.select(*keys, "r", "b", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("cnt", "pos")])
    offsets = offsets.groupBy(*keys, "r").agg(F.array_sort(F.collect_list(F.struct("b", "cnt", "pos"))).alias("v"))
    offsets = offsets.select(*keys, "r", F.col("v.cnt").alias("cnt"), F.col("v.pos").alias("pos"))
    areas = rows.groupBy(*keys, "r").cogroup(offsets.groupBy(*keys, "r")).applyInPandas(
        _range_areas(n_iterations, keys), f"{kinds}b array<long>, auc array<double>, ap array<double>")
    areas = areas.select(*keys, F.inline(F.arrays_zip("b", "auc", "ap"))).groupBy(*keys, "b").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap"))
    totals = long.groupBy(*keys, "b").agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"), F.sum("hit").alias("hit"))
    on = F.col("_b") == F.col("b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = areas.join(totals.select(F.col("b").cast("long").alias("_b"), *[F.col(k).alias(f"_{k}") for k in keys], "cnt", "pos", "hit"), on)
    joined = joined.where((F.col("pos") > 0) & (F.col("cnt") > F.col("pos")))
    return joined.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("b").cast("int").alias("b"), (F.col("hit") / F.col("pos")).alias("recall"),
                         (F.col("auc") / (F.col("pos") * (F.col("cnt") - F.col("pos")))).alias("roc_auc"), (F.col("ap") / F.col("pos")).alias("pr_auc"))


def bootstrap_iterations(scored: DataFrame, y: str = "y", pred: str = "pred", p: str = "p",
                         by: Sequence[str] = (), n_iterations: int = N_ITERATIONS, seed: int = 42) -> DataFrame:
    """(by…, b, recall, roc_auc, pr_auc) for every iteration with both classes. Rows without a score are left out."""
    return iteration_metrics(score_cells(scored, y, pred, p, by, seed), n_iterations, y, pred, p, by)


def bootstrap_ci(scored: DataFrame, y: str = "y", pred: str = "pred", p: str = "p", by: Sequence[str] = (),
                 n_iterations: int = N_ITERATIONS, seed: int = 42) -> DataFrame:
    """(by…, metric, mean, lower_95, upper_95, n_valid)."""
    it = bootstrap_iterations(scored, y, pred, p, by, n_iterations, seed)
    long = it.unpivot([*by, "b"], ["recall", "roc_auc", "pr_auc"], "metric", "v")
    pct = F.percentile(F.col("v"), F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), pct.alias("_q"),
                                           F.count(F.lit(1)).alias("n_valid")) \
        .select(*by, "metric", "mean", F.col("_q")[0].alias("lower_95"), F.col("_q")[1].alias("upper_95"), "n_valid")
