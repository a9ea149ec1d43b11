"""A metric partition index: cells around centres, pruned by radius and by box.

Centres are a bounded hash sample of the reference rows. Every reference row goes to a cell: the
centre nearest to it among those of its nearest head centre (a two-level choice, so a row is
compared with about 2·√cells centres). For each cell one table row holds what its rows
measure to: how many there are, the least and greatest distance to the centre, and per column the least
and greatest value and how many are present. The table has at most ``INDEX_NUMBERS`` numbers
a kind, whatever the input, and every task gets it.

No reference row of a cell is closer to a query q than

* max(d(q, centre) − radius, nearest − d(q, centre)), by the triangle inequality, and
* the distance from q to the cell's box, column by column.

A k-nearest search has two rounds. The first compares each query with the cells of its nearest centres
that together hold k rows, which gives a bound on its k-th distance. The second compares
it with every other cell whose lower bound does not exceed that. So the answer is exact, nothing is capped, and no loop
is needed. Cells are numbered side by side and travel in blocks: a query goes once to each block that holds a cell it needs,
with a mask of those cells, and only with their rows is it compared. Blocks meet their queries in slices of bounded size,
with numpy inside tasks, so neither a crowded cell nor a popular one is one task's work. Of equal reference rows only the first k + 1 by key
can be in an answer; the others are left out before anything is compared.

With ``nan_euclidean`` (values may be missing) only the boxes prune: a column counts for a cell
that has it in all rows and a query that has it, and the distance's scale √(columns / shared columns) is at
least √(columns / the query's columns). Cells are then larger and come of halvings of the sample along its widest columns,
for each pattern of missing columns alone; a task halves the rows of its cell further, along the columns that its queries have
(``halvings``), so queries that lack different columns are each compared with few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.halvings import LEAF, QUERIES_ALONE, SAMPLED, Splits, Tree, patterns, trees_of
from riskframe.session import materialize

#: Reference rows of a cell on average (all columns there: smaller cells are left out more often); numbers that the centres may hold in all, centres at most.
CELL_ROWS, NEAR_ROWS, INDEX_NUMBERS, MOST_CELLS = 256, 128, 1 << 20, 1 << 16
#: Cells of a block (bits of a mask); rows of a slice of a block's references or queries; distances worked out at a time, and in a sieve.
BLOCK, SLICE, STEP, SIEVE = 62, 16384, 1 << 20, 1 << 18
#: Cells at least that a query's first round looks at: the closer its bound, the fewer the second one has to.
HOMES = 8
#: The same where every pair may be given back: a slice's queries and references.
PAIR_SLICES = 2048, 1024
#: Queries that look for cells together; cells among which they look for their first ones; rows of a table given back.
TOGETHER, AROUND, GIVEN = 64, 64, 1 << 15
#: Where values may be missing: rows of a cell at least by default, and at most, cells that a table has at least if they are large, cells at most.
PART_ROWS, WIDE_ROWS, WIDE_CELLS, MOST_WIDE = 4096, 65536, 48, 8192
#: The same: a slice's queries and references.
WIDE_SLICES = 65536, 98304
#: Lower bounds are loosened by this share, against rounding.
SLACK = 1e-12

METRICS = ("euclidean", "manhattan", "nan_euclidean")


def matrix(column, width: int) -> np.ndarray:
    """Rows of equal length as a matrix, missing values as NaN."""
    return np.concatenate([np.zeros(0), *column]).astype(np.float64, copy=False).reshape(len(column), width)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows): distances, terms added in column order; inf where no column is shared or one is missing."""
    total, shared = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    for c in range(q.shape[1]):
        diff = q[:, c, None] - x[None, :, c]
        diff = np.abs(diff) if metric == "manhattan" else diff * diff
        if metric == "nan_euclidean":
            here = ~np.isnan(diff)
            shared += here
            diff = np.where(here, diff, 0.0)
        total += diff
    if metric == "nan_euclidean":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt(q.shape[1] / shared * total), np.inf)
    out = total if metric == "manhattan" else np.sqrt(total)
    return np.where(np.isnan(out), np.inf, out)


def _length(parts: np.ndarray, metric: str) -> np.ndarray:
    """Length of the vectors along the last axis."""
    return np.abs(parts).sum(axis=-1) if metric == "manhattan" else np.sqrt((parts * parts).sum(axis=-1))


@dataclass
class Cells:
    """What every task knows of the index."""

    metric: str
    fill: np.ndarray  # per column, in place of a missing value where a row looks for a centre
    centres: np.ndarray | None  # none where values may be missing
    heads: dict[bytes, np.ndarray]  # per pattern of missing columns (b"": any), the numbers of its head centres
    members: dict[int, np.ndarray]  # per head, its centres' numbers
    scale: np.ndarray  # per column, its weight where a row looks for a centre
    rows: np.ndarray | None = None  # per cell, from here on
    radius: np.ndarray | None = None
    nearest: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    present: np.ndarray | None = None

    @property
    def plain(self) -> str:
        return "manhattan" if self.metric == "manhattan" else "euclidean"

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.fill, x)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of each row. Rows go to centres that lack the same columns, where there are any."""
        cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        kinds, of = patterns(x)
        x = self.filled(x) * self.scale
        for p, kind in enumerate(kinds):
            heads, rows = self.heads.get(kind, self.heads[b""]), np.flatnonzero(of == p)
            for k in range(0, len(rows), max(1, STEP // len(heads))):
                some = rows[k:k + max(1, STEP // len(heads))]
                head = heads[distances(x[some], self.centres[heads] * self.scale, self.plain).argmin(axis=1)]
                for h in np.unique(head):
                    own, mates = some[head == h], self.members[h]
                    for at in range(0, len(own), max(1, STEP // len(mates))):
                        part = own[at:at + max(1, STEP // len(mates))]
                        d = distances(x[part], self.centres[mates] * self.scale, self.plain)
                        best = d.argmin(axis=1)
                        cell[part], far[part] = mates[best], d[np.arange(len(part)), best]
        return cell, far

    def bounds(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """(queries, those cells): a distance that no row of the cell falls below."""
        if self.metric != "nan_euclidean":
            return self._whole_bounds(q, some)
        out = np.zeros((len(q), len(some)))
        low, high, whole = self.low[some], self.high[some], self.present[some] == self.rows[some][:, None]
        for c in range(q.shape[1]):
            gap = np.maximum(np.maximum(low[None, :, c] - q[:, c, None], q[:, c, None] - high[None, :, c]), 0.0)
            gap = np.where(np.isnan(gap) | ~whole[None, :, c], 0.0, gap)
            out += gap * gap
        # columns that a cell has in no row are shared with nobody there
        shared = (~np.isnan(q)).astype(float) @ (self.present[some] > 0).T.astype(float)
        out *= q.shape[1] / np.maximum(shared, 1)
        return np.sqrt(out) * (1 - SLACK)

    def _whole_bounds(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """``bounds`` where no value is missing."""
        out, low, high, centres = np.zeros((len(q), len(some))), self.low[some], self.high[some], self.centres[some]
        with np.errstate(invalid="ignore", over="ignore"):
            for c in range(q.shape[1]):
                gap, above = low[None, :, c] - q[:, c, None], q[:, c, None] - high[None, :, c]
                np.maximum(gap, above, out=gap)
                np.fmax(gap, 0.0, out=gap)
                if self.metric != "manhattan":
                    gap *= gap
                out += gap
            if self.metric == "manhattan":
                near = beyond = distances(q, centres, self.plain)
            else:
                out = np.sqrt(out, out=out)
                mid = q.mean(axis=0)
                a, b = q - mid, centres - mid
                a2, b2 = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
                d2, off = a2 + b2 - 2 * a @ b.T, 1e-14 * (q.shape[1] + 4) * (a2 + b2)
                near, beyond = np.sqrt(np.maximum(d2 - off, 0.0)), np.sqrt(d2 + off)
            ring = np.maximum(near - self.radius[some], self.nearest[some] - beyond) - SLACK * (beyond + self.radius[some])
        return np.fmax(out, ring) * (1 - SLACK)

    def reach(self, q: np.ndarray, theta: float) -> np.ndarray:
        """The cells whose boxes come within ``theta`` of the box of the queries, which lack the same columns."""
        total = np.zeros(len(self.rows))
        whole = self.present == self.rows[:, None]
        has = ~np.isnan(q[0])
        if theta < np.inf:
            for c in np.flatnonzero(has):
                gap = np.maximum(np.maximum(self.low[:, c] - q[:, c].max(), q[:, c].min() - self.high[:, c]), 0.0)
                gap = np.where(np.isnan(gap) | ~whole[:, c], 0.0, gap)
                total += gap if self.metric == "manhattan" else gap * gap
            if self.metric == "nan_euclidean":
                total *= q.shape[1] / np.maximum((self.present > 0) @ has.astype(float), 1)
        far = total if self.metric == "manhattan" else np.sqrt(total)
        return np.flatnonzero(far * (1 - SLACK) <= theta)

    def likely(self, q: np.ndarray, some: np.ndarray, need: int) -> np.ndarray:
        """(queries, those cells): how far off the ``need``-th row of the cell may be, if its rows fill its box evenly; the queries lack the same columns."""
        has = ~np.isnan(q[0])
        shared = (self.present[some] > 0) & has
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            wide = np.where(shared & (self.high[some] > self.low[some]), np.log(self.high[some] - self.low[some]), 0.0)
            dims = np.maximum((wide != 0).sum(axis=1), 1)
            each = np.exp((wide.sum(axis=1) + np.log(need / self.rows[some])) / dims) * np.sqrt(q.shape[1] / np.maximum(shared.sum(axis=1), 1))
        return self.bounds(q, some) + np.nan_to_num(each, nan=0.0)

    def around(self, q: np.ndarray, wants: np.ndarray, need: int) -> np.ndarray:
        """Cells near the middle of the queries that hold ``need`` rows with each of the wanted columns."""
        if self.centres is None:
            to = self.likely(q.mean(axis=0)[None, :], np.arange(len(self.rows)), need)[0]
        else:
            to = distances(q.mean(axis=0)[None, :] * self.scale, self.centres * self.scale, self.plain)[0]
        held = [self.rows if w < 0 else self.present[:, w] for w in np.unique(wants)]
        if len(to) > AROUND:
            near = np.sort(np.argpartition(to, AROUND)[:AROUND])
            if all(h[near].sum() >= need for h in held):
                return near
        order = np.argsort(to, kind="stable")
        most = max(min(len(order), int(np.searchsorted(np.cumsum(h[order]), need)) + 1) for h in held)
        return order[:max(most, min(AROUND, len(order)))]

    def home(self, some: np.ndarray, to_centres: np.ndarray, want: np.ndarray, need: int, least: int = 1) -> np.ndarray:
        """(lines, those cells): the cells of the nearest centres that together hold ``need`` rows with the wanted column, ``least`` of them."""
        held = np.where(want[:, None] < 0, self.rows[some][None, :], self.present[some].T[np.maximum(want, 0)])
        order = np.argsort(to_centres, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(held, order, 1), axis=1) - np.take_along_axis(held, order, 1)
        out = np.zeros(to_centres.shape, bool)
        np.put_along_axis(out, order, (before < need) | (np.arange(len(some)) < least), axis=1)
        return out & (held > 0)


def _values(cols: Sequence[str]) -> Column:
    return F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols])


def _stats(placed: DataFrame, width: int) -> list:
    aggs = [F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"), F.min("far").alias("nearest")]
    for c in range(width):
        v = F.col("x")[c]
        aggs += [F.min(v).alias(f"low{c}"), F.max(v).alias(f"high{c}"), F.count(v).alias(f"present{c}")]
    return placed.groupBy("cell").agg(*aggs).collect()  # one row per cell


class MetricIndex:
    """An index over the rows of ``ref``; ``refs`` is its written table (cell, r_id, x)."""

    def __init__(self, ref: DataFrame, key: str, cols: Sequence[str], metric: str = "euclidean", cell_rows: int = CELL_ROWS,
                 copies: int | None = None, weights: Sequence[float] | None = None) -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.spark, self.cols, self.metric = ref.sparkSession, list(cols), metric
        width = len(self.cols)
        rows = ref.select(F.col(key).alias("r_id"), _values(self.cols).alias("x"))
        if metric != "nan_euclidean":
            rows = rows.where(~F.exists("x", lambda v: v.isNull()))
        if copies is not None:
            same = Window.partitionBy("k1", "k2").orderBy("r_id")
            rows = (rows.withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(7), "x"))
                    .withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= copies).drop("k1", "k2", "copy"))
        rows = materialize(rows, "metric-rows")
        n = rows.count()
        self.kind = rows.schema["r_id"].dataType.simpleString()
        most = max(1, min(MOST_CELLS, INDEX_NUMBERS // width, -(-n // cell_rows)))
        if metric == "nan_euclidean":
            cell_rows = max(cell_rows, min(WIDE_ROWS, n // WIDE_CELLS))
            most = max(1, min(MOST_WIDE, INDEX_NUMBERS // width // SAMPLED, -(-n // cell_rows))) * SAMPLED
        draw = F.xxhash64("x", "r_id")
        some = rows.where(draw < F.lit(int((2 * most + 64) / n * 2**64) - 2**63)) if 2 * most + 64 < n else rows
        centres = matrix([r["x"] for r in some.orderBy(draw, "r_id").limit(most).select("x").collect()], width)
        self.empty = len(centres) == 0
        if metric == "nan_euclidean":
            splits = Splits.of(centres, [1.0] * width if weights is None else weights, SAMPLED if most < n else cell_rows)
            self._fill(rows, Cells(metric, splits.fill, None, {}, {}, np.ones(width)), splits)
            return
        with np.errstate(invalid="ignore"):
            seen = ~np.isnan(centres)
            fill = np.where(seen.any(axis=0), np.nansum(centres, axis=0) / np.maximum(seen.sum(axis=0), 1), 0.0)
        centres = np.unique(centres, axis=0)
        kinds, of_kind = patterns(centres) if len(centres) else ([], np.zeros(0, int))
        scale = np.ones(width) if weights is None else np.asarray(weights, float)
        centres = np.where(np.isnan(centres), fill, centres)
        r = np.random.default_rng(len(centres))
        heads, members = {}, {}
        plain = "manhattan" if metric == "manhattan" else "euclidean"
        for p, kind in enumerate(kinds):  # the centres that lack the same columns, in two levels
            own = np.flatnonzero(of_kind == p)
            heads[kind] = np.sort(own[r.permutation(len(own))[:int(np.ceil(np.sqrt(len(own))))]])
            of = np.concatenate([distances(centres[own[k:k + 1024]] * scale, centres[heads[kind]] * scale, plain).argmin(axis=1)
                                 for k in range(0, len(own), 1024)])
            members.update({int(h): own[of == i] for i, h in enumerate(heads[kind]) if (of == i).any()})
            heads[kind] = np.array([h for h in heads[kind] if int(h) in members])
        heads[b""] = np.sort(np.concatenate([np.zeros(0, int), *heads.values()]))  # for rows that lack what no centre lacks
        if len(centres):  # numbered head by head, so that cells with numbers close by lie close by
            order = np.concatenate([members[h] for h in sorted(members)])
            at = np.argsort(order)
            centres, heads = centres[order], {kind: np.sort(at[own]) for kind, own in heads.items()}
            members = {int(at[h]): np.sort(at[own]) for h, own in members.items()}
        cells = Cells(metric, fill, centres, heads, members, scale)
        self._fill(rows, cells, cells)

    def _fill(self, rows: DataFrame, cells: Cells, home: Cells | Splits) -> None:
        """Takes the rows into the cells where ``home`` places them."""
        width = len(self.cols)
        if self.empty:
            self.refs, self.cells = rows.select(F.lit(0).cast("long").alias("cell"), "r_id", "x"), cells
            return
        shared = self.spark.sparkContext.broadcast(home)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    b["cell"], b["far"] = shared.value.place(matrix(b["x"], width))
                    yield b[["cell", "far", "r_id", "x"]]

        placed = materialize(rows.mapInPandas(place, f"cell long, far double, r_id {self.kind}, x array<double>"), "metric-cells")
        stats = sorted(_stats(placed, width), key=lambda s: s["cell"])
        # cells without rows go, the others are numbered anew in tasks by their place here
        table = lambda name: np.array([[np.nan if s[f"{name}{c}"] is None else s[f"{name}{c}"] for c in range(width)] for s in stats])
        at = np.array([s["cell"] for s in stats])
        centres = None if cells.centres is None else cells.centres[at]
        cells = Cells(self.metric, cells.fill, centres, {}, {}, cells.scale, np.array([s["rows"] for s in stats]),
                      np.array([s["radius"] for s in stats]), np.array([s["nearest"] for s in stats]), table("low"), table("high"), table("present"))
        self.cells, self.numbers, self.home = cells, at, home
        self.refs = placed.select("cell", "r_id", "x")

    def _gather(self, queries: DataFrame) -> DataFrame:
        """The queries (q_id, q, wants, thetas), those that lack the same columns and those of a neighbourhood side by side."""
        kind, width = queries.schema["q_id"].dataType.simpleString(), len(self.cols)
        if isinstance(self.home, Splits):
            shared = self.spark.sparkContext.broadcast((self.home, None))
        else:
            order = np.concatenate([self.home.members[int(h)] for h in np.unique(self.home.heads[b""])])
            shared = self.spark.sparkContext.broadcast((self.home, np.argsort(order)))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, position = shared.value
            for b in batches:
                if len(b):
                    q = matrix(b["q"], width)
                    lacks = np.isnan(q[:, :62]) @ (1 << np.arange(min(width, 62)))
                    near = cells.near(q) if position is None else position[cells.place(q)[0]]
                    yield b.assign(near=near, lacks=lacks.astype(np.int64))

        cols = f"q_id {kind}, q array<double>, wants array<int>, thetas array<double>"
        placed = materialize(queries.select("q_id", "q", "wants", "thetas").mapInPandas(place, cols + ", near long, lacks long"), "metric-queries")
        keys = [F.col("lacks"), F.col("near"), F.xxhash64("q_id")]
        return placed.repartitionByRange(*keys).sortWithinPartitions("lacks", "near").drop("lacks", "near")

    def _picker(self, pick, per: int = 1):
        """Rows of queries times the cells that ``pick(cells, q, line, wants, thetas)`` chooses, as a mapInPandas function
        that gives each query an array of their blocks of ``per`` cells and one of the blocks' masks: queries that lack the same columns and lie side by side first find the cells that any of them may need."""
        shared, width = self.spark.sparkContext.broadcast((self.cells, self.numbers)), len(self.cols)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, numbers = shared.value
            for b in batches:
                if not len(b):
                    continue
                q = matrix(b["q"], width)
                size, found, total, begun = b["wants"].map(len).to_numpy(), [], 0, 0
                wants = np.concatenate([np.asarray(w, np.int64) for w in b["wants"]])
                thetas = np.concatenate([np.asarray(w, np.float64) for w in b["thetas"]])
                ends = np.cumsum(size)
                kind = patterns(q)[1]
                cuts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True])
                groups = [slice(k, min(k + TOGETHER, hi)) for lo, hi in zip(cuts, cuts[1:]) for k in range(lo, hi, TOGETHER)]
                for part in groups:
                    lines = slice(ends[part.start] - size[part.start], ends[part.stop - 1])
                    line = np.repeat(np.arange(part.stop - part.start), size[part])
                    for i, j in pick(cells, q[part], line, wants[lines], thetas[lines]):
                        found.append((i + part.start, j))
                        total += len(i)
                    if total < GIVEN and part.stop < len(b):
                        continue
                    i, j = (np.concatenate([f[s] for f in found]) for s in (0, 1))
                    chosen = np.sort(i << 32 | numbers[j])
                    i, block, bit = chosen >> 32, (chosen & 0xFFFFFFFF) // per, (chosen & 0xFFFFFFFF) % per
                    starts = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(block) != 0)][:len(i)])
                    mask = np.bitwise_or.reduceat(np.int64(1) << bit, starts) if len(starts) else bit
                    at = np.searchsorted(i[starts], np.arange(begun + 1, part.stop))
                    lists = lambda v: np.array([*np.split(v, at), None], object)[:-1]
                    yield b.iloc[begun:part.stop].assign(blocks=lists(block[starts].astype(np.int32)), masks=lists(mask))
                    found, total, begun = [], 0, part.stop
        return run

    def _against(self, queries: DataFrame, pick, compare, out: str, slices: tuple[int, int] = (SLICE, SLICE), per: int = 1) -> DataFrame:
        """``compare(queries, refs)`` of the slices of each block of ``per`` cells over the queries (q_id, q, wants, thetas) that
        ``pick`` sends there; the queries' ``mask`` tells for which of the block's cells."""
        kind = queries.schema["q_id"].dataType.simpleString()
        cols = f"q_id {kind}, q array<double>, wants array<int>, thetas array<double>"
        asked = materialize(self._gather(queries).mapInPandas(self._picker(pick, per), cols + ", blocks array<int>, masks array<long>"), "metric-asked")
        asked = asked.select("q_id", "q", "wants", "thetas", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("masks").alias("mask"))))
        held = self.refs.withColumn("block", F.expr(f"cast(cell div {per} as int)")).withColumn("bit", F.expr(f"cast(cell % {per} as int)"))
        per_block = lambda df, most, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))
        counts = materialize(per_block(asked, slices[0], "qs").join(per_block(held, slices[1], "rs"), "block"), "metric-slices")
        own = asked.join(counts, "block").withColumn("a", F.expr("cast(pmod(xxhash64(q_id, 5), qs) as int)")) \
            .withColumn("b", F.explode(F.expr("sequence(0, rs - 1)"))).select("block", "a", "b", "q_id", "q", "wants", "thetas", "mask")
        refs = held.join(counts, "block").withColumn("b", F.expr("cast(pmod(xxhash64(r_id, 9), rs) as int)")) \
            .withColumn("a", F.explode(F.expr("sequence(0, qs - 1)"))).select("block", "a", "b", "r_id", "x", "bit")
        keys = ["block", "a", "b"]
        return own.groupBy(*keys).cogroup(refs.groupBy(*keys)).applyInPandas(compare, out)

    def nearest(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(q_id, want, r_id, dist, value, rank): for each query (q_id, q, wants) and each of its wanted columns the k
        nearest reference rows that have the column (−1: any row), ties by r_id; ``value`` is that column's."""
        kind = queries.schema["q_id"].dataType.simpleString()
        out = f"q_id {kind}, want int, r_id {self.kind}, dist double, value double"
        if self.empty:
            return self.spark.createDataFrame([], out + ", rank int")
        partial = self.metric == "nan_euclidean"
        need, least = k + int(exclude_self), 1 if partial else min(HOMES, len(self.cols))
        compare = _nearest_partial(k, exclude_self, len(self.cols)) if partial else _nearest_of(k, self.metric, exclude_self, len(self.cols))
        how = {"slices": WIDE_SLICES} if partial else {"per": BLOCK}
        best = Window.partitionBy("q_id", "want").orderBy("dist", "r_id")

        def first(cells, q, line, wants, thetas):
            some = cells.around(q, wants, need)
            to = cells.likely(q, some, need) if partial else distances(q * cells.scale, cells.centres[some] * cells.scale, cells.plain)
            go = np.zeros((len(q), len(some)), bool)
            np.logical_or.at(go, line, cells.home(some, to[line], wants, need, least))
            i, j = np.nonzero(go)
            yield i, some[j]

        queries = queries.select("q_id", "q", "wants")
        far = F.transform("wants", lambda w: F.lit(float("inf")))
        one = self._against(queries.withColumn("thetas", far), first, compare, out, **how).withColumn("rank", F.row_number().over(best))
        kth = one.where(F.col("rank") == k).groupBy("q_id", "want").agg(F.max("dist").alias("theta"))
        kth = kth.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("want", "theta"))).alias("found"))
        thetas = F.transform("wants", lambda w: F.coalesce(F.col("found")[w], F.lit(float("inf"))))
        again = queries.join(materialize(kth, "metric-near"), "q_id", "left").withColumn("thetas", F.coalesce(thetas, far))
        both = self._against(again, _every, compare, out, **how).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return materialize(both, "metric-nearest")  # so that what reads it doesn't search again

    def within(self, queries: DataFrame, eps: float) -> DataFrame:
        """(q_id, r_id, dist): for each query all reference rows at a distance of at most ``eps``."""
        kind = queries.schema["q_id"].dataType.simpleString()
        out = f"q_id {kind}, r_id {self.kind}, dist double"
        if self.empty:
            return self.spark.createDataFrame([], out)
        asked = queries.select("q_id", "q", "wants", F.transform("wants", lambda w: F.lit(eps)).alias("thetas"))
        return self._against(asked, _every, _within_of(eps, self.metric, len(self.cols)), out, PAIR_SLICES)

    def candidates(self, queries: DataFrame, found: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(q_id, rows, cells): how many reference rows and cells an exact search has to look at, given its results."""
        kth = found.groupBy("q_id", "want").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("theta"))
        kth = kth.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("want", "theta"))).alias("found"))
        thetas = F.transform("wants", lambda w: F.coalesce(F.col("found")[w], F.lit(float("inf"))))
        own = queries.join(kth, "q_id", "left").select("q_id", "q", "wants", thetas.alias("thetas"))
        kind = queries.schema["q_id"].dataType.simpleString()
        visits = self._gather(own).mapInPandas(self._picker(_every), f"q_id {kind}, q array<double>, wants array<int>, thetas array<double>, blocks array<int>, masks array<long>").withColumn("cell", F.explode("blocks"))
        sizes = self.refs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return visits.join(sizes, "cell").groupBy("q_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"))


def _every(cells: Cells, q: np.ndarray, line: np.ndarray, wants: np.ndarray, thetas: np.ndarray):
    """Picks every cell whose lower bound is at most a line's theta and that has rows for it."""
    reached = cells.reach(q, thetas.max())
    for at in range(0, len(reached), SIEVE // TOGETHER):
        some = reached[at:at + SIEVE // TOGETHER]
        held = np.where(wants[:, None] < 0, cells.rows[some][None, :], cells.present[some].T[np.maximum(wants, 0)]) > 0
        go = np.zeros((len(q), len(some)), bool)
        np.logical_or.at(go, line, held & (cells.bounds(q, some)[line] <= thetas[:, None]))
        i, j = np.nonzero(go)
        yield i, some[j]


class _Screen:
    """Squared distances to ``x`` from matrix products, and how far off they may be: a sieve before ``pair_distances``."""

    def __init__(self, x: np.ndarray, metric: str) -> None:
        self.x, self.metric, self.single = x, metric, None
        here = ~np.isnan(x)
        self.mid = np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
        moved, self.here = np.where(here, x - self.mid, 0.0), here.astype(float)
        self.top = float((moved * moved).sum(axis=1).max(initial=0.0))
        self.table = np.ascontiguousarray(np.column_stack([self.here, -2 * moved, moved * moved]).T)

    def near(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(queries, rows) whose squared distance may be at most the queries' ``limit``, by products in single precision;
        none where no exact sieve comes of that."""
        if self.metric != "euclidean" or not np.isfinite(limit).all():
            return None
        if self.single is None:
            whole = np.isfinite(self.x).all(axis=1)
            self.middle = self.x[whole].mean(axis=0) if whole.any() else np.zeros(self.x.shape[1])
            moved = np.where(whole[:, None], self.x - self.middle, 0.0)
            norms = (moved * moved).sum(axis=1)
            self.far, norms[~whole] = float(norms.max(initial=0.0)), np.inf
            self.single = np.ascontiguousarray(np.column_stack([-2 * moved, norms]).T.astype(np.float32))
        moved = q - self.middle
        norms = (moved * moved).sum(axis=1)
        top = self.far + float(norms.max(initial=0.0))
        off = 4e-7 * (q.shape[1] + 8) * top
        if not 1e-25 < top < 1e30 or off > 0.02 * np.median(limit):
            return None
        at_most = (limit + off - norms).astype(np.float32)
        close = np.flatnonzero(np.column_stack([moved, np.ones(len(q))]).astype(np.float32) @ self.single <= at_most[:, None])
        return close // len(self.x), close % len(self.x)

    def squares(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        if self.metric == "manhattan":
            d = distances(q, self.x, self.metric)
            return d * d, 1e-12 * float(np.max(d * d, initial=0.0, where=np.isfinite(d)))
        here = ~np.isnan(q)
        moved, width = np.where(here, q - self.mid, 0.0), q.shape[1]
        d2 = np.column_stack([moved * moved, moved, here.astype(float)]) @ self.table
        if self.metric == "nan_euclidean":
            shared = here.astype(float) @ self.here.T
            d2 = np.where(shared > 0, d2 * (width / np.maximum(shared, 1)), np.inf)
        else:
            d2[~here.all(axis=1)] = np.inf
            d2[:, ~self.here.all(axis=1)] = np.inf
        return d2, 1e-12 * width * (self.top + float((moved * moved).sum(axis=1).max(initial=0.0)))


def pair_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """As ``distances``, of row i of ``q`` and row i of ``x``."""
    total, shared = np.zeros(len(q)), np.zeros(len(q))
    for c in range(q.shape[1]):
        diff = q[:, c] - x[:, c]
        diff = np.abs(diff) if metric == "manhattan" else diff * diff
        if metric == "nan_euclidean":
            here = ~np.isnan(diff)
            shared += here
            diff = np.where(here, diff, 0.0)
        total += diff
    if metric == "nan_euclidean":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt(q.shape[1] / shared * total), np.inf)
    out = total if metric == "manhattan" else np.sqrt(total)
    return np.where(np.isnan(out), np.inf, out)


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line i the first k rows j by distance and place."""
    order = np.lexsort((place[j], d, i))
    i, j, d = i[order], j[order], d[order]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[few], j[few], d[few]


def _nearest_of(k: int, metric: str, exclude_self: bool, width: int):
    cols = ["q_id", "want", "r_id", "dist", "value"]

    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(refs):
            return pd.DataFrame(columns=cols)
        refs = refs.sort_values("r_id", kind="stable")
        bit = refs["bit"].to_numpy()
        order = np.argsort(bit, kind="stable")  # cell by cell; a row's number among all is its place by r_id
        bit, x, r_ids = bit[order], matrix(refs["x"], width)[order], refs["r_id"].to_numpy()[order]
        q, q_ids, mask = matrix(queries["q"], width), queries["q_id"].to_numpy(), queries["mask"].to_numpy()
        line = np.repeat(np.arange(len(q)), queries["wants"].map(len))
        wants, thetas = np.concatenate(list(queries["wants"])), np.concatenate(list(queries["thetas"]))
        # a query's own row doesn't count, as often as its key is there
        need = k + (int(refs["r_id"].value_counts().max()) if exclude_self else 0)
        edges = np.flatnonzero(np.r_[True, np.diff(bit) != 0, True])
        out = []
        for want in np.unique(wants):
            mine, hits = np.flatnonzero(wants == want), []
            for low, high in zip(edges, edges[1:]):
                own = mine[(mask[line[mine]] >> bit[low]) & 1 == 1]
                have = low + (np.flatnonzero(~np.isnan(x[low:high, want])) if want >= 0 else np.arange(high - low))
                if not len(have) or not len(own):
                    continue
                screen, step = _Screen(x[have], metric), max(1, SIEVE // len(have))
                for at in range(0, len(own), step):
                    part = own[at:at + step]
                    here = screen.near(q[line[part]], thetas[part] ** 2 * (1 + 1e-9))
                    if here is None or len(here[0]) > 16 * need * len(part):
                        d2, off = screen.squares(q[line[part]])
                        limit = thetas[part] ** 2 * (1 + 1e-9) + off
                        if len(have) > need and (np.isinf(limit).any() or np.count_nonzero(d2 <= limit[:, None]) > 16 * need * len(part)):
                            limit = np.minimum(limit, np.partition(d2, need - 1, axis=1)[:, need - 1] * (1 + 1e-9) + 2 * off)
                        here = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
                    i, j = part[here[0]], have[here[1]]
                    d = pair_distances(q[line[i]], x[j], metric)
                    keep = (d <= thetas[i]) & (d < np.inf)
                    if exclude_self:
                        keep &= q_ids[line[i]] != r_ids[j]
                    hits.append(_first(i[keep], j[keep], d[keep], order, k))
                if sum(len(h[0]) for h in hits) > 4 * k * len(mine):
                    hits = [_first(*(np.concatenate([h[s] for h in hits]) for s in range(3)), order, k)]
            if hits:
                i, j, d = _first(*(np.concatenate([h[s] for h in hits]) for s in range(3)), order, k)
                out.append(pd.DataFrame({"q_id": q_ids[line[i]], "want": int(want), "r_id": r_ids[j], "dist": d,
                                         "value": x[j, want] if want >= 0 else np.nan}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=cols)

    return run


def _nearest_partial(k: int, exclude_self: bool, width: int):
    """As ``_nearest_of``, where values may be missing and all references are of one cell."""
    cols = ["q_id", "want", "r_id", "dist", "value"]

    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(refs):
            return pd.DataFrame(columns=cols)
        refs = refs.sort_values("r_id", kind="stable")
        x, r_ids = matrix(refs["x"], width), refs["r_id"].to_numpy()
        q, q_ids = matrix(queries["q"], width), queries["q_id"].to_numpy()
        line = np.repeat(np.arange(len(q)), queries["wants"].map(len))
        wants, thetas = np.concatenate(list(queries["wants"])), np.concatenate(list(queries["thetas"]))
        need = k + (int(refs["r_id"].value_counts().max()) if exclude_self else 0)
        parts, shared, place, out = trees_of(x), {}, np.arange(len(x)), []
        kind = patterns(q)[1]
        order = np.lexsort((wants, kind[line]))
        edges = np.flatnonzero(np.r_[True, (np.diff(kind[line[order]]) != 0) | (np.diff(wants[order]) != 0), True])
        asking, own, last = np.bincount(kind), {}, -1
        for lo, hi in zip(edges, edges[1:]):
            mine, want, p = order[lo:hi], wants[order[lo]], kind[line[order[lo]]]
            has = np.flatnonzero(~np.isnan(q[line[mine[0]]]))
            if p != last:
                own, last = {}, p
            # few queries that lack the same columns share the trees of all such
            trees, along = (own, has) if asking[p] >= QUERIES_ALONE else (shared, np.arange(width))
            asked = []
            for t, rows in enumerate(parts):
                fit = ~np.isnan(x[rows, want]) if want >= 0 else np.ones(len(rows), bool)
                if fit.any():
                    trees[t] = trees.get(t) or Tree(x[rows], along, max(LEAF, need))
                    asked.append((rows, fit, trees[t].asked(q, has)))
            limit, hits = thetas[mine] ** 2 * (1 + 1e-9), []
            if np.isinf(limit).any():
                for _, fit, tree in asked:
                    limit = tree.tightened(line[mine], limit, need, fit)
            for rows, fit, tree in asked:
                for i, j in tree.within(line[mine], limit, fit):
                    i, j = mine[i], rows[j]
                    d = pair_distances(q[line[i]], x[j], "nan_euclidean")
                    keep = (d <= thetas[i]) & (d < np.inf)
                    if exclude_self:
                        keep &= q_ids[line[i]] != r_ids[j]
                    hits.append(_first(i[keep], j[keep], d[keep], place, k))
                    if sum(len(h[0]) for h in hits) > 4 * k * len(mine):
                        hits = [_first(*(np.concatenate([h[s] for h in hits]) for s in range(3)), place, k)]
            if hits:
                i, j, d = _first(*(np.concatenate([h[s] for h in hits]) for s in range(3)), place, k)
                out.append(pd.DataFrame({"q_id": q_ids[line[i]], "want": int(want), "r_id": r_ids[j], "dist": d,
                                         "value": x[j, want] if want >= 0 else np.nan}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=cols)

    return run


def _within_of(eps: float, metric: str, width: int):
    def run(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(refs):
            return pd.DataFrame(columns=["q_id", "r_id", "dist"])
        x, r_ids = matrix(refs["x"], width), refs["r_id"].to_numpy()
        q, q_ids = matrix(queries["q"], width), queries["q_id"].to_numpy()
        out, step = [], max(1, STEP // len(x))
        for at in range(0, len(q), step):
            d = distances(q[at:at + step], x, metric)
            i, j = np.nonzero(d <= eps)
            out.append(pd.DataFrame({"q_id": q_ids[at + i], "r_id": r_ids[j], "dist": d[i, j]}))
        return pd.concat(out, ignore_index=True)

    return run
