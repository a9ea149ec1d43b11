"""Classification metrics over a scored table ``(key…, y, pred?, p)``.

All metrics are aggregates over the scored table; the curve-based ones share
the curve table of ``riskframe.operators.curves``. Grouping columns (``by``)
are low-cardinality (a model id), so per-group stat rows are tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import fixed
from riskframe.operators.curves import cheapest_threshold, curve_table, score_groups, summarize_curve
from riskframe.operators.quantiles import select_quantiles
from riskframe.session import materialize

# Published fixed values of the reference's operational tables.
SIMULATION_THRESHOLDS = [0.1, 0.2, 0.3, 0.5, 0.7, 0.9]
HEART_CONFUSION_CUTS = (0.2, 0.3)
KIDNEY_CONFUSION_CUTS = (0.25, 0.35)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _div0(num: Column, den: Column) -> Column:
    """num/den, 0 when the denominator is 0 (scikit-learn's zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def apply_threshold(p, t) -> Column:
    """``p >= t`` as 0/1."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return (_c(p) >= t).cast("int")


def confusion_matrix(scored: DataFrame, y: str = "y", pred="pred", by: Sequence[str] = ()) -> DataFrame:
    yc, pc = _c(y), _c(pred)
    return scored.groupBy(*by).agg(
        F.count_if((yc == 0) & (pc == 0)).alias("tn"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"), F.count_if((yc == 1) & (pc == 1)).alias("tp"))


def _from_confusion(tn, fp, fn, tp) -> dict:
    n = tn + fp + fn + tp
    return {
        "accuracy": _div0(tp + tn, n),
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "f1_score": _div0(2 * tp, 2 * tp + fp + fn),
    }


def core_metrics(scored: DataFrame, y: str = "y", pred="pred", p: str = "p",
                 by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1_score (0 on empty denominators), roc_auc,
    pr_auc (step average precision), false_negatives, false_positives.

    One plan: confusion cells ride along as additive columns of the curve
    table, so the scored table is scanned once."""
    yc, pc = _c(y).cast("bigint"), _c(pred).cast("bigint")
    extra = {"_tp": yc * pc, "_fp": (1 - yc) * pc, "_fn": yc * (1 - pc), "_tn": (1 - yc) * (1 - pc)}
    src = scored.select(*by, y if isinstance(y, str) else yc.alias("y"), p, *[e.alias(k) for k, e in extra.items()])
    ysrc = y if isinstance(y, str) else "y"
    c = curve_table(src, ysrc, p, by, extra={k: F.col(k) for k in extra})
    s = summarize_curve(c, by, [F.sum(k).alias(k) for k in extra])
    m = _from_confusion(F.col("_tn"), F.col("_fp"), F.col("_fn"), F.col("_tp"))
    return s.select(*by, *[v.alias(k) for k, v in m.items()], "roc_auc", "pr_auc",
                    F.col("_fn").alias("false_negatives"), F.col("_fp").alias("false_positives"))


def classification_report(scored: DataFrame, y: str = "y", pred="pred", by: Sequence[str] = ()) -> DataFrame:
    """Per class precision/recall/f1/support, then accuracy, macro avg, weighted avg
    rows (accuracy sits in the f1 column, as in the familiar text report)."""
    cm = confusion_matrix(scored, y, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    s0, s1 = (tn + fp), (tp + fn)
    nd = n.cast("double")

    def row(label, pr, rc, f, sup):
        return F.struct(F.lit(label).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("bigint").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None), F.lit(None), _div0(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, nd), _div0(r0 * s0 + r1 * s1, nd),
            _div0(f0 * s0 + f1 * s1, nd), n))
    return cm.select(*by, F.inline(rows))


def threshold_simulation(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                         thresholds: Sequence[float] = SIMULATION_THRESHOLDS) -> DataFrame:
    """(by…, threshold, tp, fn, fp, healthy_flagged_rate) — one pass of
    conditional counts for all cut-offs, unpivoted; rate = fp/(tn+fp) as
    ``'%.3f%%'``, ``'0.000%'`` when there are no negatives."""
    yc, pc = _c(y), _c(p)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = pc >= F.lit(float(t))
        aggs += [F.count_if(hit & (yc == 1)).alias(f"tp{i}"), F.count_if(~hit & (yc == 1)).alias(f"fn{i}"),
                 F.count_if(hit & (yc == 0)).alias(f"fp{i}"), F.count_if(~hit & (yc == 0)).alias(f"tn{i}")]
    wide = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"fn{i}").alias("fn"), F.col(f"fp{i}").alias("fp"),
                              F.col(f"tn{i}").alias("tn")) for i, t in enumerate(thresholds)])
    long = wide.select(*by, F.inline(rows))
    neg = F.col("tn") + F.col("fp")
    rate = F.when(neg > 0, fixed(F.col("fp") / neg * 100.0, 3, percent=True)).otherwise(F.lit("0.000%"))
    return long.select(*by, "threshold", "tp", "fn", "fp", rate.alias("healthy_flagged_rate"))


def attach_group_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach one stats row per group: an equi-join that Spark broadcasts where
    the measured size of ``stats`` (one row per ``by`` key) allows; with no
    grouping the single row is read back as literals."""
    if by:
        return df.join(stats, list(by))
    row = stats.first()
    return df.select("*", *[F.lit(row[c]).alias(c) for c in stats.columns])


def threshold_confusions(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                         cuts: Sequence[float] = HEART_CONFUSION_CUTS, fn_cost: float = 5.0,
                         fp_cost: float = 1.0) -> DataFrame:
    """Confusion cells at a low fixed cut, the cost-optimal cut and a high
    fixed cut: (by…, cut, threshold, tn, fp, fn, tp)."""
    c = materialize(curve_table(scored, y, p, by), "confusions")  # the scored rows are read once
    opt = cheapest_threshold(c, by, fn_cost, fp_cost).select(*by, F.col("threshold").alias("_opt"))
    s = attach_group_stats(c, opt, by)
    named = [("low", F.lit(float(cuts[0]))), ("optimal", F.col("_opt")), ("high", F.lit(float(cuts[1])))]
    # a curve row counts all scores from its own on, so a cut's counts are the greatest at or above it
    aggs = [F.first("_opt").alias("_opt"), F.first("tt").alias("_tt"), F.first("nn").alias("_nn")]
    for i, (_, t) in enumerate(named):
        aggs += [F.coalesce(F.max(F.when(F.col("threshold") >= t, F.col(k))), F.lit(0)).cast("long").alias(f"{k}{i}") for k in ("tp", "fp")]
    wide = s.groupBy(*by).agg(*aggs)
    thr = [F.lit(float(cuts[0])), F.col("_opt"), F.lit(float(cuts[1]))]
    rows = F.array(*[F.struct(F.lit(name).alias("cut"), thr[i].alias("threshold"), (F.col("_nn") - F.col(f"fp{i}")).alias("tn"),
                              F.col(f"fp{i}").alias("fp"), (F.col("_tt") - F.col(f"tp{i}")).alias("fn"), F.col(f"tp{i}").alias("tp"))
                     for i, (name, _) in enumerate(named)])
    return wide.select(*by, F.inline(rows))


def brier_score(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(F.pow(_c(p) - _c(y), 2)).alias("brier_score"))


def brier_verdict(raw: Column, calibrated: Column) -> Column:
    return F.when(calibrated < raw, F.lit("calibration improved probability estimates")) \
        .otherwise(F.lit("calibration did not improve probability estimates"))


def calibration_curve(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                      bins: int = 10) -> DataFrame:
    """Quantile-binned reliability table: (by…, bin, mean_pred, frac_pos, n).

    Edges are linear-interpolated quantiles of p; a row goes to bin
    ``#interior edges < p`` (right-closed interior bins); empty bins vanish.
    The scored rows are read once: edges and bins come from one written table
    of (by…, p, positives, rows)."""
    g = score_groups(scored, y, p, by).select(*by, F.col(p).cast("double").alias("_v"), F.col("cnt").alias("_n"), F.col("pos").alias("_pos"))
    g = materialize(g, "calibration")
    edges = select_quantiles(g, [i / bins for i in range(bins + 1)], by).withColumnRenamed("q", "_edges")
    s = attach_group_stats(g, edges, by)
    v = F.col("_v")
    number = sum((F.when(F.col("_edges")[i] < v, 1).otherwise(0) for i in range(2, bins)), F.when(F.col("_edges")[1] < v, 1).otherwise(0)) \
        if bins > 1 else F.lit(0)
    return s.groupBy(*by, number.alias("bin")).agg((F.sum(v * F.col("_n")) / F.sum("_n")).alias("mean_pred"),
                                                   (F.sum("_pos") / F.sum("_n")).alias("frac_pos"), F.sum("_n").alias("n"))


METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc",
                  "false_negatives", "false_positives"]


def compare_models(scored: DataFrame, model: str = "model", y: str = "y", pred="pred",
                   p: str = "p") -> DataFrame:
    """One row of core metrics per model — one job for all models."""
    return core_metrics(scored, y, pred, p, by=[model])


def rank_models(comparison: DataFrame, model: str = "model") -> DataFrame:
    """Recall desc, precision desc, model name asc (deterministic tie-break); first row."""
    return (comparison.orderBy(F.col("recall").desc(), F.col("precision").desc(), F.col(model).asc())
            .limit(1))


def melt_metrics(comparison: DataFrame, model: str = "model",
                 metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc")
                 ) -> DataFrame:
    """Wide comparison → long (model, metric, score)."""
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    return comparison.select(model, *cols).unpivot([model], list(metrics), "metric", "score")
