"""Score curves: ROC, precision-recall, average precision, cost-optimal cut-off.

Everything derives from one *curve table*: per distinct score (threshold) the
number of rows and positives scoring at least that threshold. Plan:

1. ``groupBy(by, p)`` — map-side partial aggregation, so row skew (a third of
   all rows on one score) collapses into one row before the shuffle.
2. Two-phase prefix sum over the distinct scores: when the table holds more
   than ROWS_PER_WINDOW rows, it is range-partitioned into buckets; a
   cumulative window runs inside each ``(by, bucket)`` and per-bucket offsets
   come from a bucket-level table of at most ``#groups + #buckets`` rows
   (broadcast where its checked size allows). No window task holds more than
   about ROWS_PER_WINDOW rows, however uneven the groups are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

DEFAULT_BUCKETS = None  # automatic: as many as the rows need


def score_groups(scored: DataFrame, y: str, p: str, by: Sequence[str] = (),
                 extra: dict | None = None) -> DataFrame:
    """(by…, p, pos, cnt, extra…) — additive summaries per distinct score."""
    aggs = [F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("cnt")]
    aggs += [F.sum(e).alias(n) for n, e in (extra or {}).items()]
    return scored.where(F.col(p).isNotNull()).groupBy(*by, p).agg(*aggs)


ROWS_PER_WINDOW = 200_000


def _range_buckets(g: DataFrame, p: str, by: Sequence[str], n_buckets: int) -> DataFrame:
    """``g`` with ``_bucket``: range partitions of (by…, p), numbered in order and written, so that both
    phases see the same numbers. Rows are distinct in (by…, p), so a group of any share of them is cut
    into as many buckets as its rows need."""
    ranged = g.repartitionByRange(n_buckets, *[F.col(c) for c in by], F.col(p))
    return materialize(ranged.withColumn("_bucket", F.spark_partition_id()), "curve-buckets")


#: Rows (groups × buckets) of an offset table up to which it is broadcast.
OFFSET_ROWS = 500_000


def cumulative_desc(g: DataFrame, p: str, cols: Sequence[str], by: Sequence[str] = (),
                    n_buckets: int | None = DEFAULT_BUCKETS, totals: bool = True) -> DataFrame:
    """Adds ``cum_<c>`` = Σ c over rows with score >= this score (per ``by``),
    and ``tot_<c>`` = Σ c over the whole group, by a two-phase prefix sum.

    ``g`` holds one row per (by…, p). Up to ROWS_PER_WINDOW rows in all, no group can be too large
    for one window; beyond, range buckets over all rows keep every window task near that size."""
    by = list(by)
    want = n_buckets if n_buckets is not None else -(-g.count() // ROWS_PER_WINDOW)
    if want <= 1:
        run = (Window.partitionBy(*by).orderBy(F.col(p).desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        whole = Window.partitionBy(*by)
        return g.select("*", *[F.sum(c).over(run).alias(f"cum_{c}") for c in cols],
                        *([F.sum(c).over(whole).alias(f"tot_{c}") for c in cols] if totals else []))
    g = _range_buckets(g, p, by, want)
    inner = (Window.partitionBy(*by, "_bucket").orderBy(F.col(p).desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_bucket = materialize(g.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in cols]), "curve-offsets")
    before = (Window.partitionBy(*by).orderBy(F.col("_bucket").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*by)
    offs = per_bucket.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols],
        *([F.sum(f"_b_{c}").over(whole).alias(f"tot_{c}") for c in cols] if totals else []))
    g = g.select("*", *[F.sum(c).over(inner).alias(f"_in_{c}") for c in cols])
    same = F.col("_bucket") == F.col("_k_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = g.join(F.broadcast(offs) if per_bucket.count() <= OFFSET_ROWS else offs, same)
    return out.select(
        *[c for c in g.columns if c != "_bucket" and not c.startswith("_in_")],
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols],
        *([f"tot_{c}" for c in cols] if totals else []))


def curve_table(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                extra: dict | None = None, n_buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """(by…, threshold, pos, cnt, tp, n, fp, tt, nn, extra…) per distinct score.

    ``tp``/``n`` count positives/rows with score >= threshold, ``tt``/``nn`` are
    the group's positives/negatives.
    """
    # the distinct-score table is written once: the sizing pass and the
    # cumulative pass both read it instead of re-scanning the scored rows
    g = materialize(score_groups(scored, y, p, by, extra), "curve")
    c = cumulative_desc(g, p, ["pos", "cnt"], by, n_buckets)
    return c.select(
        *by, F.col(p).alias("threshold"), "pos", "cnt", *list((extra or {}).keys()),
        F.col("cum_pos").alias("tp"), F.col("cum_cnt").alias("n"),
        (F.col("cum_cnt") - F.col("cum_pos")).alias("fp"),
        F.col("tot_pos").alias("tt"), (F.col("tot_cnt") - F.col("tot_pos")).alias("nn"))


def _recall(c):
    return F.when(F.col("tt") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("tt"))


def pr_curve(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
             n_buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """(by…, threshold, precision, recall, tp, fp): predicted positive iff score >= threshold."""
    c = curve_table(scored, y, p, by, n_buckets=n_buckets)
    return c.select(*by, "threshold", (F.col("tp") / F.col("n")).alias("precision"),
                    _recall(c).alias("recall"), "tp", "fp")


def roc_curve(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
              n_buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """(by…, threshold, fpr, tpr) at every distinct score, plus the (0, 0) origin
    (threshold NULL). Intermediate collinear points are kept."""
    c = curve_table(scored, y, p, by, n_buckets=n_buckets)
    pts = c.select(*by, "threshold", F.try_divide(F.col("fp"), F.col("nn")).alias("fpr"),
                   F.try_divide(F.col("tp"), F.col("tt")).alias("tpr"))
    origin = (c.select(*by).distinct()
              .select(*by, F.lit(None).cast("double").alias("threshold"),
                      F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return origin.unionByName(pts)


def auc_terms() -> dict:
    """Per-score terms whose group sums give ROC-AUC and step average precision."""
    return {
        # negatives at this score beat (tp - pos) positives and tie with pos
        "_auc": (F.col("cnt") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0),
        # recall step × precision at this threshold
        "_ap": F.col("pos") * (F.col("tp") / F.col("n")),
    }


def summarize_curve(c: DataFrame, by: Sequence[str] = (), extra_aggs: Sequence = ()) -> DataFrame:
    """roc_auc and pr_auc per group from a curve table (one distributive aggregate)."""
    t = auc_terms()
    tt, nn = F.max("tt"), F.max("nn")
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(t["_auc"]), tt * nn).alias("roc_auc"),
        F.try_divide(F.sum(t["_ap"]), tt.cast("double")).alias("pr_auc"),
        *extra_aggs)


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return summarize_curve(curve_table(scored, y, p, by), by).select(*by, "roc_auc")


def average_precision(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return summarize_curve(curve_table(scored, y, p, by), by).select(*by, "pr_auc")


def cost_optimal_threshold(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                           fn_cost: float = 5.0, fp_cost: float = 1.0) -> DataFrame:
    """(by…, threshold, cost): argmin of fn_cost·(1−recall) + fp_cost·(1−precision)
    over distinct scores; ties resolve to the lowest threshold. The argmin is a
    distributive ``min(struct(cost, threshold))`` aggregate, not a sort."""
    return cheapest_threshold(curve_table(scored, y, p, by), by, fn_cost, fp_cost)


def cheapest_threshold(c: DataFrame, by: Sequence[str] = (), fn_cost: float = 5.0, fp_cost: float = 1.0) -> DataFrame:
    """``cost_optimal_threshold`` of a curve table."""
    cost = (F.lit(float(fn_cost)) * (1 - _recall(c)) + F.lit(float(fp_cost)) * (1 - F.col("tp") / F.col("n")))
    best = (c.select(*by, F.struct(F.round(cost, 12).alias("cost"), F.col("threshold")).alias("b"))
            .groupBy(*by).agg(F.min("b").alias("b")))
    return best.select(*by, "b.threshold", "b.cost")
