"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into groups that are certain to bring every pair
within the radius together: the 64 bits are cut into ``blocks`` blocks, and two
fingerprints that differ in r bits or fewer agree on at least blocks - r of them,
so each choice of blocks - r blocks is a grouping key. A group is sorted by
population count and compared tile against tile with numpy (exclusive-or, bit
count); a pair of tiles whose population counts are further apart than the radius
is skipped. Inside a group only a spanning forest of the links leaves the task, so
a dense group of k near copies gives k - 1 edges. Groups above ``GROUP`` rows are cut
into slices, and each pair of slices becomes a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize
from riskframe.operators.components import component_labels

#: Rows of a comparison tile; rows of a group before it is cut into slices.
TILE, GROUP = 512, 20_000
#: Shingles hashed before they are added to the bit counts.
STEP = 65_536


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash: bit set if set in over half the XXH64 values of the word shingles."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # lower() and split() of bytes know ASCII only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, STEP):
        high = min(low + STEP, n)
        if shingle == 3 and len(words) >= 3:
            some = [xxh64_intdigest(b"%b %b %b" % t, seed) for t in
                    zip(words[low:high], words[low + 1:high + 1], words[low + 2:high + 2])]
        else:
            some = [xxh64_intdigest(b" ".join(words[i:i + shingle]), seed) for i in range(low, high)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long; a null or wordless text has 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(run, "doc_id long, fp long")


# ------------------------------------------------------------------ tiles

def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def link_forest(fps: np.ndarray, radius: int, across: np.ndarray | None = None) -> np.ndarray:
    """The root index of each fingerprint after linking all pairs within ``radius`` bits.

    ``fps`` is uint64, sorted by population count. With ``across`` (a slice number per row),
    pairs inside a slice are left out.
    """
    n = len(fps)
    pops = np.bitwise_count(fps).astype(np.int64)
    parent = np.arange(n)
    for a in range(0, n, TILE):
        ra = slice(a, min(a + TILE, n))
        for b in range(a, n, TILE):
            rb = slice(b, min(b + TILE, n))
            if pops[rb.start] - pops[ra.stop - 1] > radius:
                break
            near = np.bitwise_count(fps[ra, None] ^ fps[None, rb]) <= radius
            if across is not None:
                near &= across[ra, None] != across[None, rb]
            if a == b:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            rows, cols = parent[ra].copy(), parent[rb].copy()
            while True:  # smallest root that each side reaches through this tile
                low_r = np.minimum(rows, np.where(near, cols[None, :], n).min(axis=1))
                low_c = np.minimum(cols, np.where(near, low_r[:, None], n).min(axis=0))
                if np.array_equal(low_r, rows) and np.array_equal(low_c, cols):
                    break
                rows, cols = low_r, low_c
            old = np.concatenate([parent[ra], parent[rb]])
            new = np.concatenate([rows, cols])
            changed = old != new
            for x, y in np.unique(np.stack([old[changed], new[changed]], axis=1), axis=0):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            parent = _roots(parent)
    return parent


def _short_groups(key: np.ndarray, fps: np.ndarray, radius: int, most: int):
    """Links between rows of equal key, ``most`` rows a key at most, keys adjacent: (i, j) arrays."""
    left, right = [], []
    for d in range(1, most):
        i = np.flatnonzero((key[:-d] == key[d:]) & (np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius))
        left.append(i)
        right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


#: Groups of up to this many rows are compared side by side, larger ones in tiles.
SHORT = 24


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            """All groups of ``p``, which holds whole groups in order."""
            key, pair = p["key"].to_numpy(), p["pair"].to_numpy()
            fps, part = p["fp"].to_numpy().view(np.uint64), p["part"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
            size = np.diff(np.append(first, len(p)))
            out = []
            gid = np.repeat(np.arange(len(first)), size)
            # pairs of slices take the tiled way: rows of one slice are compared elsewhere
            short = (size <= SHORT) & (pair[first] < 0)
            pick = short[gid]
            i, j = _short_groups(gid[pick], fps[pick], radius, min(SHORT, int(size.max())))
            out.append((fps[pick][i], fps[pick][j]))
            for f, n in zip(first[~short], size[~short]):
                order = f + np.argsort(np.bitwise_count(fps[f:f + n]), kind="stable")
                own = None if pair[f] < 0 or (part[f:f + n] == part[f]).all() else part[order]
                root = link_forest(fps[order], radius, own)
                tied = np.flatnonzero(root != np.arange(n))
                out.append((fps[order][tied], fps[order][root[tied]]))
            return pd.DataFrame({"a": np.concatenate([x for x, _ in out]).view(np.int64),
                                 "b": np.concatenate([y for _, y in out]).view(np.int64)})

        for b in batches:
            if not len(b):
                continue
            same = (b["key"] == b["key"].iloc[-1]) & (b["pair"] == b["pair"].iloc[-1])
            cut = len(b) - int(same.iloc[::-1].cummin().sum())
            if cut:
                yield solve(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
                held = []
            held.append(b.iloc[cut:])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b) edges over a written table of distinct fingerprints ``fp`` that connect exactly
    those linked by chains of pairs within ``radius`` bits."""
    if blocks is None:  # longer keys as the table grows, to keep groups short; the links are the same
        blocks = radius + 1 if distinct.count() < 20_000_000 else radius + 3
    masks = _block_masks(radius, blocks)
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                            .alias("choice", "bits")).select("fp", F.xxhash64("choice", "bits").alias("key"))
    dealt = materialize(dealt, "simhash-dealt")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = dealt.join(sizes, "key")
    small = dealt.where(F.col("n") <= GROUP).select("key", F.lit(-1).cast("long").alias("pair"),
                                                   F.lit(0).alias("part"), "fp")
    # slices 0..s-1 of a large group: every pair (i <= j) of them is a group
    large = (dealt.where(F.col("n") > GROUP)
             .withColumn("s", F.ceil(F.col("n") / F.lit(GROUP // 2)).cast("int"))
             .withColumn("part", F.expr("cast(pmod(xxhash64(fp, 7), s) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
             .select("key", F.expr("cast(least(part, other) as long) * 1000003 + greatest(part, other)").alias("pair"),
                     "part", "fp"))
    # a slice against itself is the group (i, i); in (i, j) only pairs across count
    groups = small.unionByName(large)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(n, "key", "pair").sortWithinPartitions("key", "pair")
    return groups.mapInPandas(_compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: documents whose fingerprints are within
    ``radius`` bits are linked, ``component_id`` is the smallest doc_id reachable.

    ``fingerprint`` is 16 lowercase hex digits. A null, empty or wordless text has
    fingerprint zero and is linked like any other; texts of fewer words than a shingle
    count as one shingle. Equal fingerprints are one node, so repeated rows link without
    pairs. Rows with a null doc_id are linked, but never name a component (if all are
    null, it is null). An empty table gives an empty result; other columns are not read.
    """
    fps = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = component_labels(near_links(nodes, radius), "a", "b").withColumnRenamed("id", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = nodes.groupBy("label").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(named, "label").select("fp", "component_id")
    return fps.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
