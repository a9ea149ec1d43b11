"""Rows halved along their widest column: cells of an index, and a search tree inside a task.

Both serve the k-nearest search where values may be missing. ``Splits`` are halvings of a sample, made on the driver, one tree
for each pattern of missing columns: they tell to which cell a row goes. ``Tree`` halves the rows that a task holds until few are
left and keeps the box of each part, so a query looks only into parts whose box is near enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Rows of a leaf; lines that go down a tree together; distances worked out at a time.
LEAF, LINES, STEP = 32, 2048, 1 << 19
#: Rows, and queries, with a pattern of missing columns of which that many get a tree of their own.
ROWS_ALONE, QUERIES_ALONE = 128, 128
#: Rows of the sample a cell.
SAMPLED = 16
#: Lower bounds are loosened by this share, against rounding.
SLACK = 1e-12


def patterns(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the patterns of missing columns, the number of each row's)."""
    kinds, of = np.unique(np.packbits(np.isnan(x), axis=1), axis=0, return_inverse=True)
    return [k.tobytes() for k in kinds], of.reshape(-1)


@dataclass
class Splits:
    """Trees of halvings; ``column`` is −1 at a leaf, whose cell is ``left``."""

    fill: np.ndarray  # per column, in place of a missing value
    roots: dict[bytes, int] = field(default_factory=dict)  # per pattern of missing columns (b"": any)
    column: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    cells: int = 0
    main: int = 0  # the root of the most frequent pattern

    @classmethod
    def of(cls, sample: np.ndarray, weights: Sequence[float], most: int) -> Splits:
        """Halvings until at most ``most`` rows of the sample are left. Patterns of fewer rows share a tree."""
        seen = ~np.isnan(sample)
        with np.errstate(invalid="ignore"):
            out = cls(np.where(seen.any(axis=0), np.where(seen, sample, 0.0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1), 0.0))
        kinds, of = patterns(sample)
        x, rare = out.filled(sample), []
        for p, kind in enumerate(kinds):
            own = np.flatnonzero(of == p)
            if len(own) < most and len(kinds) > 1:
                rare.append(own)
            else:
                out.roots[kind] = out._halve(x[own], np.asarray(weights, float) > 0, most)
        # rows that lack what no row of the sample lacks are few; with others their cells' boxes would bound nothing
        out.roots[b""] = out._halve(x[np.concatenate([np.zeros(0, int), *rare])], np.asarray(weights, float) > 0, most)
        out.main = out.roots.get(kinds[int(np.bincount(of).argmax())], out.roots[b""]) if kinds else out.roots[b""]
        return out

    def _halve(self, x: np.ndarray, usable: np.ndarray, most: int) -> int:
        at = len(self.column)
        for table, v in ((self.column, -1), (self.value, 0.0), (self.left, 0), (self.right, 0)):
            table.append(v)
        if len(x) > most:
            with np.errstate(invalid="ignore"):
                spread = np.nan_to_num(x.max(axis=0) - x.min(axis=0), nan=0.0) * usable
            c = int(spread.argmax())
            if spread[c] > 0:
                v = np.sort(x[:, c])
                cut = v[len(v) // 2] if v[len(v) // 2] > v[0] else v[np.searchsorted(v, v[0], "right")]
                low = x[:, c] < cut
                self.column[at], self.value[at] = c, float(cut)
                self.left[at], self.right[at] = self._halve(x[low], usable, most), self._halve(x[~low], usable, most)
                return at
        self.left[at], self.cells = self.cells, self.cells + 1
        return at

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.fill, x)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, 0, as there is no centre) of each row."""
        kinds, of = patterns(x)
        starts = [(self.roots.get(kind, self.roots[b""]), np.flatnonzero(of == p)) for p, kind in enumerate(kinds)]
        return self._down(self.filled(x), starts), np.zeros(len(x))

    def near(self, x: np.ndarray) -> np.ndarray:
        """A number for each row, close to those of rows close to it, whatever it lacks."""
        return self._down(self.filled(x), [(self.main, np.arange(len(x)))])

    def _down(self, x: np.ndarray, open_: list[tuple[int, np.ndarray]]) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        while open_:
            at, rows = open_.pop()
            if self.column[at] < 0:
                out[rows] = self.left[at]
                continue
            low = x[rows, self.column[at]] < self.value[at]
            open_ += [(n, part) for n, part in ((self.left[at], rows[low]), (self.right[at], rows[~low])) if len(part)]
        return out


class Tree:
    """Rows ``x`` (of which ``cols`` tell where to halve) in leaves of equal size, padded by rows of NaN, with boxes level by level."""

    def __init__(self, x: np.ndarray, cols: np.ndarray, leaf: int = LEAF) -> None:
        n, width = x.shape
        here = ~np.isnan(x)
        self.width, self.any = width, np.flatnonzero(here.any(axis=0))
        # all rows have the same columns, and differences are numbers
        self.whole = bool((here.all(axis=0) | ~here.any(axis=0)).all() and not np.isinf(x).any())
        cols = np.intersect1d(cols, self.any)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if len(cols) else 0
        total = -(-n // 2**self.depth) * 2**self.depth
        rows, key = np.full(total, -1), np.full((len(cols), total), np.nan)
        rows[:n] = np.arange(n)
        with np.errstate(invalid="ignore"):
            middle = np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
            key[:, :n] = np.where(here, x, middle)[:, cols].T
            for level in range(self.depth):
                k = key.reshape(len(cols), 2**level, -1)
                spread = np.nan_to_num(np.fmax.reduce(k, axis=2) - np.fmin.reduce(k, axis=2), nan=-1.0)
                widest = spread.argmax(axis=0)
                order = np.argpartition(k[widest, np.arange(2**level)], k.shape[2] // 2, axis=1)
                order += (np.arange(2**level) * k.shape[2])[:, None]
                rows, key = rows[order.ravel()], key[:, order.ravel()]
        self.rows = rows.reshape(2**self.depth, -1)
        padded = np.vstack([x, np.full((1, width), np.nan)])
        self.x = [np.ascontiguousarray(padded[:, c][self.rows]) for c in range(width)]
        low, high = (np.array([f.reduce(v, axis=1) for v in self.x]) for f in (np.fmin, np.fmax))
        present = np.array([(~np.isnan(v)).sum(axis=1) for v in self.x])
        held = (self.rows >= 0).sum(axis=1)
        self.low, self.high, self.has = [], [], []
        for _ in range(self.depth + 1):
            # a column bounds nothing where one of the rows lacks it
            full = present == held
            self.low.insert(0, np.where(full, low, -np.inf))
            self.high.insert(0, np.where(full, high, np.inf))
            self.has.insert(0, present > 0)
            pair = lambda v, f: f(v[..., 0::2], v[..., 1::2])
            low, high, present, held = pair(low, np.fmin), pair(high, np.fmax), pair(present, np.add), pair(held, np.add)

    def asked(self, q: np.ndarray, has: np.ndarray) -> _Asked:
        """The tree as queries ``q`` see it, which all have the columns ``has``."""
        return _Asked(self, q, has)


class _Asked:
    def __init__(self, tree: Tree, q: np.ndarray, has: np.ndarray) -> None:
        self.tree, self.q, self.cols = tree, q, np.intersect1d(has, tree.any)
        # columns that a part has in no row are shared with nobody there
        self.scale = [tree.width / np.maximum(h[self.cols].sum(axis=0), 1) for h in tree.has]

    def _bounds(self, level: int, i: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squares that no squared distance of query i to a row of the node falls below."""
        out, low, high = np.zeros(len(i)), self.tree.low[level], self.tree.high[level]
        with np.errstate(invalid="ignore", over="ignore"):
            for c in self.cols:
                q = self.q[i, c]
                gap = np.fmax(np.maximum(low[c][node] - q, q - high[c][node]), 0.0)
                out += gap * gap
            return out * self.scale[level][node] * (1 - SLACK)

    def _squares(self, i: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """(pairs, rows of a leaf): squared distances, inf where there is none."""
        tree, total = self.tree, 0.0
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            if tree.whole:
                for c in self.cols:
                    diff = tree.x[c][leaf] - self.q[i, c][:, None]
                    diff *= diff
                    total += diff
                total *= tree.width / len(self.cols)
                total[np.isnan(total)] = np.inf
                return total
            shared = np.zeros((len(i), tree.rows.shape[1]))
            for c in self.cols:
                diff = tree.x[c][leaf] - self.q[i, c][:, None]
                here = ~np.isnan(diff)
                shared += here
                total = total + np.where(here, diff * diff, 0.0)
            return np.where(shared > 0, total * (tree.width / np.maximum(shared, 1)), np.inf)

    def tightened(self, lines: np.ndarray, limit: np.ndarray, need: int, fit: np.ndarray) -> np.ndarray:
        """The lines' ``limit`` of squares, or a lower one below which ``need`` rows that ``fit`` are known to lie."""
        limit, size = limit.copy(), self.tree.rows.shape[1]
        if size < need or not len(self.cols):
            return limit
        node = np.zeros(len(lines), np.int64)
        for level in range(1, self.tree.depth + 1):
            left, right = (self._bounds(level, lines, 2 * node + s) for s in (0, 1))
            node = 2 * node + (right < left)
        good = np.r_[fit, False][self.tree.rows]
        for at in range(0, len(lines), max(1, STEP // size)):
            part = slice(at, at + max(1, STEP // size))
            d2 = np.where(good[node[part]], self._squares(lines[part], node[part]), np.inf)
            limit[part] = np.minimum(limit[part], np.partition(d2, need - 1, axis=1)[:, need - 1] * (1 + 1e-9))
        return limit

    def within(self, lines: np.ndarray, limit: np.ndarray, fit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(line's place, row) of the rows that ``fit`` with a squared distance of at most the lines' ``limit``."""
        if not len(self.cols):
            return
        tree, size = self.tree, self.tree.rows.shape[1]
        good = np.r_[fit, False][tree.rows]
        for begin in range(0, len(lines), LINES):
            i = np.arange(begin, min(begin + LINES, len(lines)))
            node = np.zeros(len(i), np.int64)
            for level in range(tree.depth + 1):
                if level:
                    i, node = np.repeat(i, 2), np.repeat(2 * node, 2)
                    node[1::2] += 1
                go = self._bounds(level, lines[i], node) <= limit[i]
                i, node = i[go], node[go]
            for at in range(0, len(i), max(1, STEP // size)):
                part, leaf = i[at:at + max(1, STEP // size)], node[at:at + max(1, STEP // size)]
                d2 = self._squares(lines[part], leaf)
                a, b = np.nonzero((d2 <= limit[part][:, None]) & (d2 < np.inf) & good[leaf])
                yield part[a], tree.rows[leaf[a], b]


def trees_of(x: np.ndarray) -> list[np.ndarray]:
    """The rows of each tree: those that lack the same columns, where there are enough of them, and the others."""
    of = patterns(x)[1]
    count = np.bincount(of)
    own = [np.flatnonzero(of == p) for p in np.flatnonzero(count >= ROWS_ALONE)]
    rest = np.flatnonzero(count[of] < ROWS_ALONE)
    return own + ([rest] if len(rest) else [])
