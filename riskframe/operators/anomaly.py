"""Anomaly detectors, the contamination cut, detector votes and consensus.

Detectors return ``(key, score)`` with larger = more anomalous; the cut turns a
score into the −1 (anomaly) / +1 (normal) flag using a percentile of the
scores of the *fit* rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.rng import KeyedBijection
from riskframe.operators.curves import cumulative_desc
from riskframe.operators.quantiles import column_quantiles, exact_quantiles, select_quantiles
from riskframe.operators.split import stratified_rank
from riskframe.session import materialize

CONTAMINATION = 0.05


# ------------------------------------------------------------------ tails (ECOD / COPOD)

def _long(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(key, F.inline(rows))


def ecdf_tails(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, feature, v, left, right): left = #(X ≤ v)/n, right = #(X ≥ v)/n per feature.

    Counts per distinct (feature, value) are partial-aggregated, cumulated by the
    two-phase prefix sum of ``curves.cumulative_desc`` (no window holds a
    whole feature), and joined back to the rows on (feature, value)."""
    long = _long(df, key, cols)
    g = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("cnt"))
    c = cumulative_desc(g, "v", ["cnt"], by=["feature"])
    tails = c.select("feature", "v",
                     ((F.col("tot_cnt") - F.col("cum_cnt") + F.col("cnt")) / F.col("tot_cnt")).alias("left"),
                     (F.col("cum_cnt") / F.col("tot_cnt")).alias("right"))
    return long.join(tails, ["feature", "v"])


def feature_skew_sign(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, skew_sign) — sign of the third central moment."""
    aggs = [F.skewness(F.col(c).cast("double")).alias(c) for c in cols]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.signum(F.coalesce(F.col(c), F.lit(0.0))).alias("skew_sign"))
                     for c in cols])
    return wide.select(F.inline(rows))


def tail_scores(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, ecod, copod) from per-feature tail surprisals U_l = −ln left,
    U_r = −ln right and the skew-selected U_s (U_r for right-skewed features,
    U_l for left-skewed, U_l + U_r when symmetric):

    * ecod  = Σ_features max(U_l, U_r, U_s)
    * copod = Σ_features max(U_s, (U_l + U_r) / 2)
    """
    t = ecdf_tails(df, key, cols)
    sk = feature_skew_sign(df, cols)  # one row per feature: bounded by the schema
    t = t.join(F.broadcast(sk), "feature")
    ul, ur = -F.log(F.col("left")), -F.log(F.col("right"))
    s = F.col("skew_sign")
    us = ul * (-F.signum(s - 1)) + ur * F.signum(s + 1)
    per = t.select(key, F.greatest(ul, ur, us).alias("e"), F.greatest(us, (ul + ur) / 2).alias("c"))
    return per.groupBy(key).agg(F.sum("e").alias("ecod"), F.sum("c").alias("copod"))


# ------------------------------------------------------------------ cut, votes, consensus

def contamination_cut(scores: DataFrame, score: str, fit_scores: DataFrame | None = None,
                      frac: float = CONTAMINATION, by: Sequence[str] = ()) -> DataFrame:
    """scores + ``flag``: −1 when score > the (1−frac) linear percentile of the
    fit rows' scores, else +1. The cut-off is a one-row (per group) aggregate."""
    fit = fit_scores if fit_scores is not None else scores
    cut = exact_quantiles(fit, score, [1.0 - frac], by).withColumn("_cut", F.col("q")[0]).drop("q")
    if by:
        s = scores.join(cut, list(by))
    else:
        s = scores.withColumn("_cut", F.lit((cut.first() or {"_cut": None})["_cut"]).cast("double"))
    return s.withColumn("flag", F.when(F.col(score) > F.col("_cut"), F.lit(-1)).otherwise(F.lit(1))).drop("_cut")


def column_votes(df: DataFrame, key: str, cols: Sequence[str], frac: float = CONTAMINATION) -> DataFrame:
    """(key, detector, flag): each column acts as a detector flagging values above
    its own (1−frac) percentile (NULL ⇒ normal)."""
    cuts = {c: q[0] for c, q in column_quantiles(df, cols, [1.0 - frac]).items()}
    rows = F.array(*[F.struct(F.lit(c).alias("detector"),
                              F.when(F.col(c) > F.lit(cuts[c]).cast("double"), F.lit(-1)).otherwise(F.lit(1)).alias("flag"))
                     for c in cols])
    return df.select(key, F.inline(rows))


def anomaly_counts(votes: DataFrame, detector: str = "detector", flag: str = "flag") -> DataFrame:
    """(detector, anomalies, normals, anomaly_pct '%.2f%%')."""
    c = votes.groupBy(detector).agg(F.count_if(F.col(flag) == -1).alias("anomalies"),
                                    F.count_if(F.col(flag) == 1).alias("normals"))
    from riskframe.functions.scalar import fixed
    return c.withColumn("anomaly_pct", fixed(F.col("anomalies") * 100.0 / (F.col("anomalies") + F.col("normals")),
                                             2, percent=True))


def anomaly_consensus(votes: DataFrame, key: str, n_detectors: int, flag: str = "flag",
                      majority: int = 3) -> DataFrame:
    """(any_detector, majority, all_detectors): rows flagged by ≥1, ≥majority, all."""
    per = votes.groupBy(key).agg(F.count_if(F.col(flag) == -1).alias("k"))
    return per.agg(F.count_if(F.col("k") >= 1).alias("any_detector"),
                   F.count_if(F.col("k") >= majority).alias("majority"),
                   F.count_if(F.col("k") == n_detectors).alias("all_detectors"))


# ------------------------------------------------------------------ Mahalanobis / elliptic envelope

def mean_cov(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and population covariance (d×d) by one aggregate."""
    d = len(cols)
    aggs = [F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(F.col(cols[i]), F.col(cols[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = df.agg(*aggs).first()
    mu = np.array([r[f"m{i}"] for i in range(d)], dtype=float)
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return mu, cov


def mahalanobis_expr(cols: Sequence[str], mu: np.ndarray, cov: np.ndarray) -> F.Column:
    """Squared Mahalanobis distance as a literal-coefficient expression; NULL where there is no mean, 0 where nothing varies."""
    if not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        return F.lit(None).cast("double")
    prec = np.linalg.pinv(cov)
    diffs = [F.col(c) - F.lit(float(mu[i])) for i, c in enumerate(cols)]
    out = F.lit(0.0)
    for i in range(len(cols)):
        for j in range(len(cols)):
            if prec[i, j] != 0.0:
                out = out + F.lit(float(prec[i, j])) * diffs[i] * diffs[j]
    return out


def mahalanobis(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, mahalanobis): squared distance to the mean under the sample covariance. No rows give no rows."""
    mu, cov = mean_cov(df, cols)
    return df.select(key, mahalanobis_expr(cols, mu, cov).alias("mahalanobis"))


#: Rows of a starting subset, how many subsets, random starts in each, starts kept for the merged subset and for all rows.
MCD_SUBSET, MCD_SUBSETS, MCD_STARTS, MCD_KEPT, MCD_LAST = 300, 5, 100, 10, 2


def chi_square_quantile(q: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(q) * np.sqrt(2 / (9 * d))) ** 3


def _distances(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    diff = x - mu
    return np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(cov), diff)


def _concentrate(x: np.ndarray, mu: np.ndarray, cov: np.ndarray, share: float, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, mean, covariance) after so many concentration steps on the rows of ``x``."""
    h = max(x.shape[1] + 1, int(np.ceil(share * len(x))))
    for _ in range(steps):
        own = x[np.argsort(_distances(x, mu, cov), kind="stable")[:h]]
        mu, cov = own.mean(axis=0), np.cov(own.T, bias=True).reshape(x.shape[1], x.shape[1])
    sign, size = np.linalg.slogdet(cov)
    return (size if sign > 0 else -np.inf), mu, cov


def nested_starts(x: np.ndarray, share: float, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best (mean, covariance) starts found on small subsets of ``x`` and carried to all of it (Rousseeuw & Van
    Driessen 1999): in each subset many starts from d + 1 random rows, two steps each; the best of them all, two steps on ``x``."""
    r, d = np.random.default_rng(seed), x.shape[1]
    x = x[r.permutation(len(x))]
    best = []
    for part in np.array_split(x, max(1, min(MCD_SUBSETS, len(x) // MCD_SUBSET))):
        found = []
        for _ in range(MCD_STARTS):
            few = part[r.choice(len(part), min(d + 1, len(part)), replace=False)]
            found.append(_concentrate(part, few.mean(axis=0), np.cov(few.T, bias=True).reshape(d, d), share, 2))
        best += sorted(found, key=lambda f: f[0])[:MCD_KEPT]
    merged = sorted((_concentrate(x, mu, cov, share, 2) for _, mu, cov in best), key=lambda f: f[0])
    return [(mu, cov) for _, mu, cov in merged[:MCD_LAST]]


def elliptic_envelope(df: DataFrame, key: str, cols: Sequence[str], support_fraction: float | None = None,
                      max_steps: int = 1000, seed: int = 42) -> DataFrame:
    """(key, score): robust squared Mahalanobis distance by the covariance of least determinant (Rousseeuw & Van Driessen).

    Starts come from a bounded hash sample (``MCD_SUBSETS`` × ``MCD_SUBSET`` rows) and are carried to all rows: keep the h
    closest rows, re-estimate, repeat until mean and covariance stay the same (relative 1e-5, absolute 1e-8; each step lowers the
    determinant, so the steps end). Of the last starts the one with the least determinant stays; its covariance is scaled
    so that the median distance is that of normal data, and mean and covariance are taken once more from all rows
    within the 97.5 % quantile. Each step is one aggregate + one quantile; the d×d inverse is on the driver. Rows with a
    NULL or NaN have no score; constant columns add nothing; no rows give no rows. Raises if ``max_steps`` are too few."""
    cols, d = list(cols), len(cols)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = materialize(df.where(whole).select(key, *[F.col(c).cast("double").alias(c) for c in cols]), "envelope")
    n = rows.count()
    if n == 0:
        return df.select(key, F.lit(None).cast("double").alias("score"))
    h = int(np.ceil(support_fraction * n)) if support_fraction else (n + d + 1) // 2
    frac = min(1.0, h / n)
    size = MCD_SUBSETS * MCD_SUBSET
    draw = F.xxhash64(F.col(key), F.lit(seed))
    some = rows.where(draw < F.lit(int((2 * size + 64) / n * 2**64) - 2**63)) if 2 * size + 64 < n else rows
    sample = np.array([list(r)[1:] for r in some.orderBy(draw, key).limit(size).collect()], float)
    ends = []
    for mu, cov in nested_starts(sample, frac, seed):
        for _ in range(max_steps):
            scored = _scored(rows, cols, mu, cov)
            cut = select_quantiles(scored, [frac]).first()["q"][0]
            mu_new, cov_new = _moments_within(scored, mu, cut)
            done = np.allclose(mu_new, mu) and np.allclose(cov_new, cov)
            mu, cov = mu_new, cov_new
            if done:
                break
        else:
            raise RuntimeError(f"elliptic envelope: support still changes after {max_steps} steps")
        sign, logdet = np.linalg.slogdet(cov)
        ends.append((logdet if sign > 0 else -np.inf, len(ends), mu, cov))
    _, _, mu, cov = min(ends, key=lambda e: e[:2])
    middle = select_quantiles(_scored(rows, cols, mu, cov), [0.5]).first()["q"][0]
    cov = cov * (middle / chi_square_quantile(0.5, d)) if middle else cov
    mu, cov = _moments_within(_scored(rows, cols, mu, cov), mu, chi_square_quantile(0.975, d))
    return df.select(key, F.when(whole, mahalanobis_expr(cols, mu, cov)).alias("score"))


def _scored(rows: DataFrame, cols: list[str], mu: np.ndarray, cov: np.ndarray) -> DataFrame:
    """(x, _v, _n): the rows with their squared distance, written. Numpy batches, so that a step's new mean and
    covariance don't make Spark compile new code."""

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        return pd.Series(_distances(np.array(x.tolist(), float).reshape(len(x), len(mu)), mu, cov))

    x = F.array(*cols)
    return materialize(rows.select(x.alias("x"), distance(x).alias("_v"), F.lit(1).cast("long").alias("_n")), "envelope-scored")


def _moments_within(scored: DataFrame, around: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of the rows at a distance of at most ``cut``, from sums around a point."""
    d = len(around)

    def sums(batches):
        total = np.zeros(1 + d + d * d)
        for b in batches:
            x = np.array(b["x"][b["_v"] <= cut].tolist(), float).reshape(-1, d) - around
            total += np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]
        yield pd.DataFrame({"s": [total.tolist()]})

    each = scored.select("x", "_v").mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    got = np.array([r["s"] for r in each.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])
    mean = got[1:1 + d] / got[0]
    return around + mean, got[1 + d:].reshape(d, d) / got[0] - np.outer(mean, mean)


# ------------------------------------------------------------------ isolation forest

def _c_factor(n):
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + 0.5772156649) - 2.0 * (n - 1.0) / np.maximum(n, 1.0), 0.0)
    return np.where(n == 2, 1.0, out)


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType())])


def _build_tree(pdf, cols, seed, max_depth):
    """One isolation tree from ≤ sample rows (hashed RNG seeded by tree id)."""
    tree = int(pdf["tree"].iloc[0])
    x = pdf[list(cols)].to_numpy(dtype=float)
    rng = np.random.default_rng([int(seed), tree])
    nodes = []

    def grow(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        lo, hi = np.nanmin(sub, axis=0), np.nanmax(sub, axis=0)
        live = np.where(hi > lo)[0]
        if len(live) == 0:
            nodes[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        f = int(rng.choice(live))
        s = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < s
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[nid] = (tree, nid, f, s, left, right, len(idx), depth)
        return nid

    grow(np.arange(len(x)), 0)
    return pd.DataFrame(nodes, columns=[f.name for f in NODE_SCHEMA.fields])


def iforest_draws(n: int, trees: int, sample: int, seed: int = 42) -> list[tuple[int, int]]:
    """(tree, rank from 1): the ranks of each tree's subsample of n rows."""
    few = np.arange(min(sample, n))
    return [(t, int(r) + 1) for t in range(trees) for r in (KeyedBijection(n, seed, t)(few) if n else ())]


def iforest_fit(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, sample: int = 256,
                seed: int = 42) -> DataFrame:
    """Node table of an isolation forest (Liu, Ting & Zhou 2008).

    The rows get dense ranks by hash of their key, in two phases. Tree t's subsample is the rows whose ranks are the
    images of 0 … sample − 1 under a bijection keyed by (seed, t): exactly ``sample`` different rows (all, if there
    are fewer), drawn on the driver as trees × sample numbers, whatever the input. Rows meet them in one
    join by rank. Each tree is built from ≤ sample rows in ``applyInPandas`` — bounded groups. No rows give no nodes."""
    ranked = stratified_rank(df.select(key, *cols, F.lit(0).alias("_all")), key, "_all", seed)
    ranked = materialize(ranked.drop("_all"), "iforest-ranks")
    n = ranked.count()
    draws = iforest_draws(n, trees, sample, seed)
    picks = df.sparkSession.createDataFrame(draws, "tree int, _rank long")
    sub = ranked.join(F.broadcast(picks), "_rank").drop("_rank", "_class_n")  # trees × sample rows of 12 bytes
    max_depth = int(np.ceil(np.log2(max(sample, 2))))
    cols = list(cols)
    return sub.groupBy("tree").applyInPandas(lambda pdf: _build_tree(pdf, cols, seed, max_depth), NODE_SCHEMA)


def iforest_score(df: DataFrame, key: str, cols: Sequence[str], nodes: DataFrame, sample: int = 256) -> DataFrame:
    """(key, score) with score = 2^(−E[h(x)]/c(sample)). The node table
    (trees × ≤ 2·sample rows) is collected once and shipped in the closure —
    bounded by the forest parameters, not the data."""
    nd = nodes.toPandas().sort_values(["tree", "node"])
    forest = []
    for _, g in nd.groupby("tree"):
        forest.append({k: g[k].to_numpy() for k in ("feature", "split", "left", "right", "size", "depth")})
    psi = int(nd.loc[nd["node"] == 0, "size"].max()) if len(nd) else sample
    c_n = float(_c_factor(psi)) or 1.0
    cols = list(cols)

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for t in forest:
                node = np.zeros(len(x), dtype=int)
                active = t["feature"][node] >= 0
                while active.any():
                    f = t["feature"][node[active]]
                    s = t["split"][node[active]]
                    v = x[np.where(active)[0], f]
                    nxt = np.where(v < s, t["left"][node[active]], t["right"][node[active]])
                    node[active] = nxt
                    active = t["feature"][node] >= 0
                total += t["depth"][node] + _c_factor(t["size"][node])
            eh = total / max(len(forest), 1)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "score": np.power(2.0, -eh / c_n)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, *cols).mapInPandas(score, f"{key} {key_type}, score double")


# ------------------------------------------------------------------ linear autoencoder / one-class SVM

def autoencoder_recon(df: DataFrame, key: str, cols: Sequence[str], k: int = 2,
                      fit: DataFrame | None = None) -> DataFrame:
    """(key, score): squared reconstruction error of a linear autoencoder with a
    k-unit bottleneck, whose optimum is the top-k principal subspace (Baldi &
    Hornik 1989): ‖(x−μ) − V_k V_kᵀ (x−μ)‖². Covariance is one aggregate; the
    projection and residual are column expressions."""
    mu, cov = mean_cov(fit if fit is not None else df, cols)
    vals, vecs = np.linalg.eigh(cov)
    v = vecs[:, np.argsort(vals)[::-1][:k]]
    proj = v @ v.T
    resid = []
    for i, c in enumerate(cols):
        r = F.col(c) - F.lit(float(mu[i]))
        for j, cj in enumerate(cols):
            if proj[i, j] != 0.0:
                r = r - F.lit(float(proj[i, j])) * (F.col(cj) - F.lit(float(mu[j])))
        resid.append(r * r)
    total = resid[0]
    for r in resid[1:]:
        total = total + r
    return df.select(key, total.alias("score"))


def min_norm_weights(points: np.ndarray) -> np.ndarray:
    """Weights (not negative, sum 1) of the point of least norm in the hull of the rows: non-negative
    least squares (Lawson & Hanson 1974) of the rows, each with a 1 appended, against (0, …, 0, 1)."""
    a = np.c_[points, np.ones(len(points))].T
    x, held = np.zeros(len(points)), np.zeros(len(points), bool)
    target = np.r_[np.zeros(points.shape[1]), 1.0]
    for _ in range(30 * len(points) + 30):
        slope = np.where(held, -np.inf, a.T @ (target - a @ x))
        if slope.max() <= 1e-13:
            break
        held[np.argmax(slope)] = True
        while True:
            z = np.zeros(len(x))
            z[held] = np.linalg.lstsq(a[:, held], target, rcond=None)[0]
            if (z[held] > 0).all():
                break
            down = np.flatnonzero(held & (z <= 0))
            x = x + (x[down] / (x[down] - z[down])).min() * (z - x)
            held &= x > 1e-15
            x[~held] = 0.0
        x = z
    return x / x.sum()


#: Relative duality gap at which the one-class SVM is solved, and bins of a step's margins.
SVM_TOLERANCE, SVM_BINS = 1e-3, 8192


def one_class_svm(df: DataFrame, key: str, cols: Sequence[str], nu: float = 0.05, n_components: int = 64,
                  gamma: float | None = None, tolerance: float = SVM_TOLERANCE, max_steps: int = 1000, seed: int = 42,
                  fit: DataFrame | None = None) -> DataFrame:
    """(key, score): RBF one-class SVM approximated in a random Fourier feature
    space (Rahimi & Recht 2007): the optimum of ½‖w‖² + 1/(νn)·Σ max(0, ρ − w·z) − ρ,
    whose w is the point of least norm among the means of z with weights of at most 1/(νn).
    Each step finds the mean of the νn rows of smallest w·z (a count by margin, then two sums) and
    moves w to the point of least norm in the hull of the means found so far. It ends when the duality gap
    ‖w‖² − w·mean is at most ``tolerance``·‖w‖² and raises if ``max_steps`` are too few.
    score = ρ − w·z (> 0 ⇒ outside the support)."""

    from riskframe.operators.models import gamma_scale, random_fourier_features
    base = fit if fit is not None else df
    g = gamma if gamma is not None else gamma_scale(base, cols)
    zc = [f"_z{i}" for i in range(n_components)]
    zfit = random_fourier_features(base.select(*cols), cols, g, n_components, seed, "_z") \
        .select(F.array(*zc).alias("z"))
    zfit = materialize(zfit, "svm-features")
    n = zfit.count()
    if n == 0:
        return df.select(key, F.lit(None).cast("double").alias("score"))

    def lowest(w):
        """(mean z of the νn rows of smallest margin, rows of the last bin by equal shares; what an exact cut could lower it by)."""
        reach = np.sqrt(2.0) * np.linalg.norm(w) + 1e-12  # no margin is larger
        width = 2 * reach / SVM_BINS

        def bins(z):
            return np.clip(((z @ w + reach) / width).astype(int), 0, SVM_BINS - 1)

        def count(batches):
            for pdf in batches:
                if len(pdf):
                    b, k = np.unique(bins(np.stack(pdf["z"].to_numpy())), return_counts=True)
                    yield pd.DataFrame({"b": b, "k": k})

        found = zfit.mapInPandas(count, "b long, k long").groupBy("b").agg(F.sum("k").alias("k")).collect()
        counts = np.zeros(SVM_BINS)
        for r in found:
            counts[r["b"]] = r["k"]
        last = int(np.searchsorted(np.cumsum(counts), nu * n))
        share = (nu * n - counts[:last].sum()) / counts[last]

        def total(batches):
            acc = np.zeros(len(w))
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf["z"].to_numpy())
                    b = bins(z)
                    acc += z[b < last].sum(axis=0) + share * z[b == last].sum(axis=0)
            yield pd.DataFrame({"s": [acc.tolist()]})

        sums = zfit.mapInPandas(total, "s array<double>").select(F.posexplode("s").alias("i", "s"))
        sums = sums.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # one row per component
        return np.array([r["s"] for r in sums]) / (nu * n), width * share * counts[last] / (nu * n)

    hull = lowest(np.full(n_components, 1.0 / np.sqrt(n_components)))[0][None]
    for _ in range(max_steps):
        weights = min_norm_weights(hull)
        hull, w = hull[weights > 0], weights @ hull
        mean, slack = lowest(w)
        if w @ w - w @ mean + slack <= tolerance * (w @ w) or w @ w <= 1e-12:
            break
        hull = np.vstack([hull, mean])
    else:
        raise RuntimeError(f"one-class SVM: duality gap above {tolerance} after {max_steps} steps")

    margin = sum((F.col(c) * F.lit(float(w[i])) for i, c in enumerate(zc[1:], 1)), F.col(zc[0]) * F.lit(float(w[0])))
    z = random_fourier_features(base.select(*cols), cols, g, n_components, seed, "_z")
    rho = column_quantiles(z.select(margin.alias("m")), ["m"], [nu])["m"][0]
    z = random_fourier_features(df.select(key, *cols), cols, g, n_components, seed, "_z")
    return z.select(key, (F.lit(rho) - margin).alias("score"))
