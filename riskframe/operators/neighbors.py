"""k-nearest-neighbour and ε-range joins, and k-nearest imputation, on the metric partition index.

All are exact, without a cross join and without a cap on candidates; ties are broken by
the reference key. ``metric_index`` tells how cells are chosen, bounded and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.metric_index import CELL_ROWS, NEAR_ROWS, PART_ROWS, MetricIndex, _values
from riskframe.operators.range_counts import within_counts
from riskframe.session import materialize


def knn_join(query: DataFrame, ref: DataFrame, qkey: str, rkey: str, cols: Sequence[str], k: int = 5,
             metric: str = "euclidean", exclude_self: bool = False, cell_rows: int = NEAR_ROWS) -> DataFrame:
    """(q_id, r_id, dist, rank) — the k nearest reference rows of every query row (fewer when fewer
    references exist), exact.

    Rows with a null or NaN among ``cols`` have no Euclidean or Manhattan distance: such a reference is nobody's
    neighbour, such a query has none. ``nan_euclidean`` = sqrt(columns / shared columns · Σ over shared columns (q−r)²)
    leaves out only pairs that share no column. ``exclude_self`` leaves out references whose key is the query's.
    Rows that repeat a query key count as one query each, so their keys should differ."""
    index = MetricIndex(ref, rkey, cols, metric, cell_rows, copies=k + int(exclude_self))
    found = index.nearest(_asked(query, qkey, cols, metric), k, exclude_self)
    return found.select("q_id", "r_id", "dist", "rank")


def _asked(query: DataFrame, key: str, cols: Sequence[str], metric: str) -> DataFrame:
    rows = query.select(F.col(key).alias("q_id"), _values(cols).alias("q"), F.array(F.lit(-1)).alias("wants"))
    return rows if metric == "nan_euclidean" else rows.where(~F.exists("q", lambda v: v.isNull()))


def knn_candidates(query: DataFrame, ref: DataFrame, qkey: str, rkey: str, cols: Sequence[str], k: int = 5,
                   metric: str = "euclidean", exclude_self: bool = False, cell_rows: int = NEAR_ROWS) -> DataFrame:
    """(q_id, rows, cells) — how many references and cells ``knn_join`` has to look at for each query."""
    index = MetricIndex(ref, rkey, cols, metric, cell_rows, copies=k + int(exclude_self))
    asked = _asked(query, qkey, cols, metric)
    return index.candidates(asked, index.nearest(asked, k, exclude_self), k, exclude_self)


def eps_pairs(df: DataFrame, key: str, cols: Sequence[str], eps: float, metric: str = "euclidean",
              cell_rows: int = CELL_ROWS, counted: bool = False) -> DataFrame:
    """(a, b, dist) for every ordered pair (self included) within ``eps``: each row meets the cells whose
    lower bound is at most ``eps``, and each pair is verified with the exact distance. Rows with a
    null among ``cols`` are in no pair.

    ``counted``: (a, n) instead, the same pairs counted by ``a`` in the tasks that find them; ``a``'s number of pairs is the sum of
    its ``n``, and no row is made for a pair."""
    if counted:
        return within_counts(df, key, cols, eps, metric)
    index = MetricIndex(df, key, cols, metric, cell_rows)
    pairs = index.within(_asked(df, key, cols, metric), eps)
    return pairs.select(F.col("q_id").alias("a"), F.col("r_id").alias("b"), "dist")


def knn_impute(df: DataFrame, train: DataFrame, key: str, cols: Sequence[str], k: int = 5, cell_rows: int = PART_ROWS) -> DataFrame:
    """Fill NULLs with the mean of the k nearest *training* rows that have the
    feature (nan-Euclidean distance over the co-present columns, ties by key).
    A row with no usable donor gets the training column mean.

    A row is one query, however many columns it lacks; only rows that lack some are compared at all. All
    training rows are in one index, whatever they lack."""
    cols = list(cols)
    # both are read several times: what makes them runs once
    df, train = materialize(df, "impute-rows"), materialize(train.select(key, *cols), "impute-train")
    lacks = F.filter(F.array(*[F.when(F.isnull(c) | F.isnan(F.col(c).cast("double")), F.lit(i)) for i, c in enumerate(cols)]),
                     lambda i: i.isNotNull())
    queries = df.select(F.col(key).alias("q_id"), _values(cols).alias("q"), lacks.alias("wants")).where(F.size("wants") > 0)
    # cells are halved along the columns that most queries have: along others every query meets every cell
    asked = df.where(F.size(lacks) > 0).agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"c{i}") for i, v in enumerate(
        F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols)]).first()
    weights = [float(2 * asked[f"c{i}"] >= asked["n"]) for i in range(len(cols))]
    index = MetricIndex(train, key, cols, "nan_euclidean", cell_rows, copies=k, weights=weights if any(weights) else None)
    found = index.nearest(queries, k)
    # the k values are added in order of rank, so the mean doesn't depend on partitions
    inner = found.groupBy("q_id", "want").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("vs"))
    inner = inner.select("q_id", "want", (F.aggregate("vs", F.lit(0.0), lambda s, v: s + v["value"]) / F.size("vs")).alias("v"))
    wide = inner.groupBy(F.col("q_id").alias(key)).agg(*[F.max(F.when(F.col("want") == i, F.col("v"))).alias(f"_imp_{c}")
                                                         for i, c in enumerate(cols)])
    means = train.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]).first()
    out = df.join(wide, key, "left")
    whole = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return out.withColumns({c: F.coalesce(whole(c), F.col(f"_imp_{c}"), F.lit(means[c])) for c in cols}) \
              .drop(*[f"_imp_{c}" for c in cols])
