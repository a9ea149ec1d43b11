"""Best-fit-decreasing sharding: groups of rows that must stay together, by size.

Groups are summed up into size classes with Spark; the packing itself runs over
the classes. A class (size, how many groups) is placed in one go: best-fit gives
the tightest bin that still takes the size, and while that bin takes further
groups of the same size it stays the tightest, so it is filled before the next
one is looked up. Groups then take their place by their rank inside their class.

Class sizes keep 15 significant bits (sizes below 32,768 are exact, larger ones
are rounded up by 1/16,384 at most), which bounds the class table at 16,384 rows
per power of two for any input, and never overfills a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import dense_numbers, materialize, row_identity, utf8

CLASS_BITS = 15


class CapacityTree:
    """A two-level balanced tree (sorted leaves under a sorted spine) over (remaining, bin)."""

    LEAF = 256

    def __init__(self) -> None:
        self._leaves: list[list[tuple[int, int]]] = []
        self._high: list[tuple[int, int]] = []

    def add(self, remaining: int, bin_id: int) -> None:
        item = (remaining, bin_id)
        if not self._leaves:
            self._leaves, self._high = [[item]], [item]
            return
        k = min(bisect_left(self._high, item), len(self._leaves) - 1)
        insort(self._leaves[k], item)
        self._high[k] = self._leaves[k][-1]
        if len(self._leaves[k]) > self.LEAF:
            leaf = self._leaves[k]
            half = len(leaf) // 2
            self._leaves[k:k + 1] = [leaf[:half], leaf[half:]]
            self._high[k:k + 1] = [leaf[half - 1], leaf[-1]]

    def all(self) -> list[tuple[int, int]]:
        return [item for leaf in self._leaves for item in leaf]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining room that holds ``size``."""
        k = bisect_left(self._high, (size, -1))
        if k == len(self._leaves):
            return None
        i = bisect_left(self._leaves[k], (size, -1))
        found = self._leaves[k].pop(i)
        if self._leaves[k]:
            self._high[k] = self._leaves[k][-1]
        else:
            del self._leaves[k], self._high[k]
        return found


def pack_classes(classes: list[tuple[int, int]], capacity: int):
    """Best-fit-decreasing over (size, count) classes, largest size first.

    Returns runs (size, first rank, rank after the last, bin). A size above ``capacity`` gets bins of its own.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in classes:
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                found = (max(capacity, size), bins)
                bins += 1
            room, bin_id = found
            n = min(count - rank, room // size)
            runs.append((size, rank, rank + n, bin_id))
            rank += n
            tree.add(room - n * size, bin_id)
    return runs


def _level(rooms: list[tuple[int, int]], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each bin (room, bin) gets if each goes to the bin with the most room."""
    def given(level: int) -> list[int]:
        return [max(0, -(-(room - level) // size)) for room, _ in rooms]

    low, high = min(r for r, _ in rooms) - size * count - 1, max(r for r, _ in rooms)
    while high - low > 1:  # given(low) is enough, given(high) isn't
        middle = (low + high) // 2
        low, high = (middle, high) if sum(given(middle)) >= count else (low, middle)
    out = given(high)
    for _ in range(count - sum(out)):
        k = max(range(len(rooms)), key=lambda i: (rooms[i][0] - out[i] * size, -rooms[i][1]))
        out[k] += 1
    return out


def balance_classes(classes: list[tuple[int, int]], shards: int):
    """Runs (size, first rank, rank after the last, bin) that fill ``shards`` bins as evenly as best-fit-decreasing
    can: a group larger than its fair share gets a bin to itself; the other bins are all open from the start with
    the fair share of the rest as their room, a group goes to the bin with the least room that holds
    it, and where none does, to the bin with the most room."""
    classes, own, runs = [list(c) for c in classes], 0, []
    total, ranks = sum(s * n for s, n in classes), {}
    for c in classes:
        while c[1] and own < shards - 1 and c[0] * (shards - own) > total:
            rank = ranks.get(c[0], 0)
            runs.append((c[0], rank, rank + 1, own))
            ranks[c[0]], total, own = rank + 1, total - c[0], own + 1
            c[1] -= 1
    tree, fair = CapacityTree(), -(-total // (shards - own))
    for k in range(own, shards):
        tree.add(fair, k)
    for size, count in classes:
        rank = ranks.get(size, 0)
        end = rank + count
        while rank < end:
            found = tree.take_tightest(size)
            if found is None:
                rooms = tree.all()
                given, tree = _level(rooms, size, end - rank), CapacityTree()
                for (room, bin_id), n in zip(rooms, given):
                    if n:
                        runs.append((size, rank, rank + n, bin_id))
                    rank += n
                    tree.add(room - n * size, bin_id)
                break
            room, bin_id = found
            n = min(end - rank, room // size)
            runs.append((size, rank, rank + n, bin_id))
            rank += n
            tree.add(room - n * size, bin_id)
    return runs


def _class_of(size: str):
    """``size`` rounded up to CLASS_BITS significant bits."""
    return F.expr(f"shiftleft(shiftright({size} + shiftleft(1L, greatest(length(bin({size})) - {CLASS_BITS}, 0)) - 1, "
                  f"greatest(length(bin({size})) - {CLASS_BITS}, 0)), greatest(length(bin({size})) - {CLASS_BITS}, 0))")


def shard_groups(rows: DataFrame, key: str, size: str, shards: int | None = None,
                 capacity: int | None = None) -> DataFrame:
    """(key, shard): a shard for each distinct ``key`` of ``rows``, whose size is the sum of
    its rows' ``size`` (1 or more each).

    With ``capacity``, as few shards of that capacity as best-fit-decreasing needs;
    with ``shards``, that many shards of nearly equal size. Groups of one size are
    told apart by their keys' hashes, so a run is repeatable.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    groups = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(size).cast("long").alias("_size"))
    groups = materialize(groups.select("_key", _class_of("_size").alias("_class")), "shard-groups")
    counted = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: see CLASS_BITS
    classes = sorted(((r[0], r[1]) for r in counted), reverse=True)
    runs = balance_classes(classes, shards) if capacity is None else pack_classes(classes, capacity)
    spark = rows.sparkSession
    table = spark.createDataFrame(runs or [], "_class long, _from long, _to long, _shard int")
    if len(runs) <= 1_000_000:  # 28 bytes a row
        table = F.broadcast(table)
    ranked = dense_numbers(groups, ["_class"], ["_key"], "_rank")
    placed = ranked.join(table, "_class").where("_rank >= _from and _rank < _to")
    return placed.select(F.col("_key").alias(key), F.col("_shard").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of ``shards`` shards of nearly
    equal bytes, rows with equal texts together, ``slot`` gapless from 0 in each shard.

    ``size`` is the text's UTF-8 bytes plus 1; null texts have no bytes, form one
    group of their own and have a null CRC. An empty text has CRC 0. Repeated rows
    each keep their place. A group larger than a fair share fills a shard alone; no
    shard stays empty while there are as many groups as shards.
    An empty table gives an empty result; other columns are not read.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(utf8(text)) + 1).cast("long").alias("size"),
                       F.when(text.isNotNull(), F.crc32(utf8(text))).alias("text_crc32"),
                       row_identity(text_col).alias("_group"))
    base = materialize(base, "shard-rows")
    placed = base.join(shard_groups(base, "_group", "size", shards=shards), "_group").drop("_group")
    placed = materialize(placed, "shard-placed")
    return dense_numbers(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
