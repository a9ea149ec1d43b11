"""How many rows lie within ε of each row, without a row for each pair.

Rows are halved into blocks (``halvings``); blocks whose boxes come within ε meet, each two of them once. A meeting
counts for both sides: squared distances come of a matrix product in single precision, with a margin for its rounding,
and pairs inside the margin are decided by the exact distance. Tiles of a meeting whose boxes are further apart than ε are
left out, tiles that lie within ε as a whole are counted whole. The number of meetings grows with the square of the number of
blocks where ε reaches most rows; a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.halvings import SAMPLED, SLACK, Splits, Tree
from riskframe.operators.metric_index import distances, pair_distances
from riskframe.session import materialize

#: Rows of a block at least and at most, blocks that a table has at least if they are large, blocks of a sample at most.
LEAST, MOST, BLOCKS, MOST_BLOCKS = 1024, 32768, 16, 4096
#: Rows and columns of a tile: a column's count fits a byte, a tile has whole runs of 128 words.
TILE, WORDS = (128, 4096), 128


def _columns(batch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(f"c{c}").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
                            else batch.column(f"c{c}").to_numpy() for c in range(width)])


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance that a row of the box (low, high) and one of each of the others may have."""
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.fmax(np.maximum(lows - high, low - highs), 0.0)
        most = np.maximum(highs - low, high - lows)
        length = lambda v: v.sum(axis=-1) if metric == "manhattan" else np.sqrt((v * v).sum(axis=-1))
        return length(gap) * (1 - SLACK), np.nan_to_num(length(most), nan=np.inf) * (1 + SLACK)


def count_within(a: np.ndarray, b: np.ndarray, eps: float, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """(for each row of ``a`` the rows of ``b`` within ``eps``, the other way round)."""
    width, (tall, wide) = a.shape[1], TILE
    both = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    if not len(a) or not len(b):
        return both
    orders = []
    for x, leaf in ((a, tall), (b, wide)):
        rows = Tree(x, np.arange(width), leaf).rows.ravel()
        orders.append(rows[rows >= 0])
    a, b = a[orders[0]], b[orders[1]]
    boxes = [(np.minimum.reduceat(x, np.arange(0, len(x), step)), np.maximum.reduceat(x, np.arange(0, len(x), step)))
             for x, step in ((a, tall), (b, wide))]
    screen = _single(a, b, eps) if metric == "euclidean" else None
    ns, ms = np.zeros(len(a), np.int64), np.zeros(-(-len(b) // (8 * WORDS)) * 8 * WORDS, np.int64)
    for t, at in enumerate(range(0, len(a), tall)):
        q = slice(at, min(at + tall, len(a)))
        near, far = _apart(boxes[0][0][t], boxes[0][1][t], *boxes[1], metric)
        for s in np.flatnonzero(near <= eps):
            x = slice(s * wide, min(s * wide + wide, len(b)))
            if far[s] <= eps and np.isfinite(far[s]):
                ns[q] += x.stop - x.start
                ms[x] += q.stop - q.start
            elif screen is None:
                close = distances(a[q], b[x], metric) <= eps
                ns[q] += close.sum(axis=1)
                ms[x] += close.sum(axis=0)
            else:
                left, right, sure, maybe = screen
                x32 = slice(x.start, min(x.start + wide, len(ms)))
                d2 = left[q] @ right[:, x32]
                close, edge = d2 <= sure, d2 <= maybe
                i, j = np.divmod(np.flatnonzero(close != edge), close.shape[1])
                if len(i):
                    close[i, j] = pair_distances(a[q][i], b[x][j], metric) <= eps
                ns[q] += np.add.reduce(close.view(np.uint64).reshape(len(close), -1, WORDS), axis=2).view(np.uint8).reshape(
                    len(close), -1).sum(axis=1, dtype=np.int64)
                ms[x32] += np.add.reduce(close.view(np.uint8), axis=0, dtype=np.uint8)
    both[0][orders[0]], both[1][orders[1]] = ns, ms[:len(b)]
    return both


def _single(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.float32, np.float32] | None:
    """Matrices whose product is the squared distances in single precision (inf in columns past ``b``), the square below which a
    pair is surely within ``eps`` and the one above which it surely isn't; none where that decides too little."""
    if not (0 <= eps < 1e15 and np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    mid = (a.mean(axis=0) + b.mean(axis=0)) / 2
    p, r = a - mid, b - mid
    p2, r2 = (p * p).sum(axis=1), (r * r).sum(axis=1)
    top, limit = float(p2.max() + r2.max()), float(eps) ** 2
    off = 4e-7 * (a.shape[1] + 8) * top
    if not 1e-25 < top < 1e30 or off > 0.02 * limit:
        return None
    left = np.column_stack([-2 * p, p2, np.ones(len(p))]).astype(np.float32)
    right = np.zeros((a.shape[1] + 2, -(-len(b) // (8 * WORDS)) * 8 * WORDS), np.float32)
    right[-1] = np.inf
    right[:, :len(b)] = np.column_stack([r, np.ones(len(r)), r2]).T
    edges = (limit * (1 - 1e-9) - off, -np.inf), (limit * (1 + 1e-9) + off, np.inf)
    return left, right, *(np.nextafter(np.float32(v), np.float32(to)) for v, to in edges)


def within_counts(df: DataFrame, key: str, cols: Sequence[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """(a, n): parts of the number of rows within ``eps`` of each row (itself included), one for each meeting of its block that
    has some. Rows with a null or NaN among ``cols`` are in no pair."""
    spark, width, names = df.sparkSession, len(cols), [f"c{c}" for c in range(len(cols))]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = materialize(df.select(F.col(key).alias("r_id"), *[value(c).alias(n) for c, n in zip(cols, names)]).dropna(subset=names), "range-rows")
    kind, n = rows.schema["r_id"].dataType.simpleString(), rows.count()
    if not n:
        return spark.createDataFrame([], f"a {kind}, n long")
    most = max(LEAST, min(MOST, n // BLOCKS), -(-n // MOST_BLOCKS))
    draw, size = F.xxhash64(*names, "r_id"), -(-n // most) * SAMPLED
    some = rows.where(draw < F.lit(int((2 * size + 64) / n * 2**64) - 2**63)) if 2 * size + 64 < n else rows
    sample = np.array([tuple(r) for r in some.orderBy(draw, "r_id").limit(size).select(*names).collect()], float).reshape(-1, width)
    splits = spark.sparkContext.broadcast(Splits.of(sample, [1.0] * width, max(1, len(sample) * most // n)))
    fields = ", ".join(f"{c} double" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = splits.value.place(_columns(b, width))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], [*b.schema.names, "block"])

    placed = materialize(rows.mapInArrow(place, f"r_id {kind}, {fields}, block long"), "range-blocks")
    stats = sorted(placed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).collect(),
                   key=lambda s: s["block"])  # one row per block
    # a block that couldn't be halved further is cut by hash: its cuts have its box
    cuts = np.array([-(-s["rows"] // (2 * most)) for s in stats])
    first = np.cumsum(cuts) - cuts
    low, high = (np.repeat(np.array([[s[f"{f}{c}"] for c in names] for s in stats], float), cuts, axis=0) for f in ("min", "max"))
    at, units = {s["block"]: (int(f), int(c)) for s, f, c in zip(stats, first, cuts)}, int(cuts.sum())
    shared = spark.sparkContext.broadcast((at, low, high))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, low, high = shared.value
        meets = {}
        for b in batches:
            block, lot = b.column("block").to_numpy(), b.column("lot").to_numpy()
            unit = np.array([blocks[k][0] + v % blocks[k][1] for k, v in zip(block.tolist(), lot.tolist())], np.int64)
            for u in np.unique(unit):
                if u not in meets:
                    v = np.flatnonzero(_apart(low[u], high[u], low, high, metric)[0] <= eps)
                    meets[u] = np.minimum(u, v) * len(low) + np.maximum(u, v)
            lists = pa.array([meets[u] for u in unit.tolist()], pa.list_(pa.int64()))
            keep = [b.column(c) for c in ("r_id", *names)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(unit), lists], ["r_id", *names, "unit", "meets"])

    def count(group: pa.Table) -> pa.Table:
        unit, x = group.column("unit").to_numpy(), _columns(group, width)
        pair = group.column("g")[0].as_py()
        sides = [np.flatnonzero(unit == u) for u in (pair // units, pair % units)]
        n = np.zeros(len(unit), np.int64)
        found = count_within(x[sides[0]], x[sides[1]], eps, metric)
        n[sides[1]] = found[1]
        n[sides[0]] = found[0]
        some = np.flatnonzero(n)
        return pa.table({"a": group.column("r_id").take(pa.array(some)), "n": pa.array(n[some])})

    lot = F.pmod(F.xxhash64("r_id", F.lit(5)), F.lit(1 << 20))
    met = placed.withColumn("lot", lot).mapInArrow(meet, f"r_id {kind}, {fields}, unit long, meets array<long>")
    met = met.select("r_id", *names, "unit", F.explode("meets").alias("g"))
    return met.groupBy("g").applyInArrow(count, f"a {kind}, n long")
