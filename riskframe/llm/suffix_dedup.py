"""Removal of byte strings of ``length`` bytes that also start elsewhere, by column-wise suffix sorting.

A collection's Burrows-Wheeler order can be built column by column: in each round every
document inserts its next symbol to the left, which moves it by a stable sort of the
last round's order, and the common prefix with its new neighbour follows from the last
round's common prefixes. Whole texts would take as many rounds as the longest has bytes,
so the documents of a collection are here the surroundings of one anchor.

Anchors are minimizers: of each string's k-grams the one with the smallest hash, the last
of equals. Equal strings have their anchor at the same place, so a string can only repeat
among the strings that the same k-gram anchors, aligned at it, and a run of
consecutive strings with one anchor is one short document of ``2 * length`` bytes at
most. Runs are sorted and joined as Spark tables, the external files of the method:

1. every run is written with the hash of its anchor and of its bytes;
2. anchors that occur once are dropped: their strings can't repeat;
3. runs of equal bytes (under one anchor) repeat as a whole;
4. where an anchor has different runs, one of each is read back and the collection of
   the anchor is built column-wise; neighbours with common prefixes of ``length`` tell
   the strings that repeat. A collection above ``GROUP`` runs is resolved by counting the
   hashes of its single strings instead, so that no task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import join_counted, materialize, utf8

#: Bytes of an anchor's k-gram; bytes of text looked at in one go; runs sorted in one go; runs of a collection.
GRAM, CHUNK, BLOCK, GROUP = 40, 1 << 19, 8192, 8192

_ORDER = (1 << 24) - 1  # low bits of a sort value hold the place in the chunk


# ------------------------------------------------------------------ anchors

def _table(seed: int = 12345) -> np.ndarray:
    """A 64-bit value for each byte (splitmix steps)."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK + 1024), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each k-gram of ``data`` (uint8)."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table()[data] * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[:len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values."""
    n, pad = len(v), -len(v) % w
    full = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchored_runs(data: bytes, starts: np.ndarray, length: int, k: int):
    """(start, strings, anchor, hash of the anchor's k-gram) of the runs of consecutive string starts
    with one anchor; ``starts`` are the places in ``data`` where a string begins."""
    x = np.frombuffer(data, np.uint8)
    h = gram_hashes(x, k)
    value = (h & ~np.uint64(_ORDER)) | (np.uint64(_ORDER) - np.arange(len(h), dtype=np.uint64))
    low = _sliding_min(value, length - k + 1)[starts]
    anchor = _ORDER - (low & np.uint64(_ORDER)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(new, len(starts)))
    return starts[new], n, anchor[new], h[anchor[new]].view(np.int64)


def _pieces(texts, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) lists of about CHUNK bytes; long texts in pieces that overlap by length - 1."""
    out, size = [], 0
    for row, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), CHUNK):
            piece = data[at:at + CHUNK + length - 1]
            if size + len(piece) > CHUNK + length and out:
                yield out
                out, size = [], 0
            out.append((row, at, piece))
            size += len(piece)
    if out:
        yield out


def _find_runs(length: int, k: int):
    """Rows (k1, k2, h, c, place): place holds start, strings and anchor of the run in the document."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for pieces in _pieces([bytes(t) for t in b["data"]], length):
                data = b"".join(p for _, _, p in pieces)
                sizes = np.array([len(p) for _, _, p in pieces])
                begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                own = sizes - length + 1
                piece = np.repeat(np.arange(len(pieces)), own)
                starts = np.arange(len(piece)) + np.repeat(begin - np.concatenate([[0], np.cumsum(own)[:-1]]), own)
                s, n, a, h = anchored_runs(data, starts, length, k)
                at = np.searchsorted(begin, s, side="right") - 1
                c = np.array([xxh3_64_intdigest(data[i:j]) for i, j in zip(s.tolist(), (s + n + length - 1).tolist())],
                             np.uint64).view(np.int64)
                rows = np.array([r for r, _, _ in pieces])[at]
                place = s - begin[at] + np.array([o for _, o, _ in pieces])[at]
                yield pd.DataFrame({"k1": k1[rows], "k2": k2[rows], "h": h, "c": c,
                                    "place": (place << 20) | (n << 10) | (a - s)})

    return run


# ------------------------------------------------------------------ column-wise construction

def repeated_strings(group: np.ndarray, contexts: list[bytes], offsets: np.ndarray, strings: np.ndarray,
                     length: int) -> np.ndarray:
    """Flags (run, string of it) of the strings that also stand, at the same distance from the
    anchor, in another run of the group. ``group`` is ascending; ``offsets`` are the anchors' places in the runs."""
    m = len(contexts)
    left, sizes = int(offsets.max()), np.array([len(c) for c in contexts])
    width = left + int((sizes - offsets).max())
    symbols = np.full((width, m), -1, np.int16)  # column-major: a round reads one row
    column = np.repeat(left - offsets, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[column, np.repeat(np.arange(m), sizes)] = np.frombuffer(b"".join(contexts), np.uint8)
    high = np.searchsorted(np.unique(group), group).astype(np.int64) * 512
    order, lcp = np.arange(m), np.zeros(m + 1, np.int64)
    flags = np.zeros((m, int(strings.max())), bool)
    for x in range(width - 1, -1, -1):
        key = high[order] + symbols[x, order] + 1
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = (key[1:] == key[:-1]) & (key[1:] & 511 != 0)
        t = np.flatnonzero(same) + 1
        fresh = np.zeros(m + 1, np.int64)
        if len(t):
            # from the old order's place after the upper neighbour to the lower neighbour's
            spans = np.stack([move[t - 1] + 1, move[t] + 1], axis=1).ravel()
            fresh[t] = np.minimum.reduceat(lcp, spans)[::2] + 1
        order, lcp = order[move], fresh
        if x <= left:
            hit = order[np.maximum(lcp[:-1], lcp[1:]) >= length]
            place = x - left + offsets[hit]
            inside = (place >= 0) & (place < strings[hit])
            flags[hit[inside], place[inside]] = True
    return flags


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _sort_columns(length: int):
    """Rows (k1, k2, low, high): starts of repeated strings, for the runs that have no equal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve() -> pd.DataFrame:
            p = pd.concat(held, ignore_index=True)
            held.clear()
            place = p["place"].to_numpy()
            group = np.cumsum(np.concatenate([[True], p["h"].to_numpy()[1:] != p["h"].to_numpy()[:-1]]))
            flags = repeated_strings(group, [bytes(c) for c in p["context"]], place & 1023, (place >> 10) & 1023, length)
            rows = []
            for i in np.flatnonzero(flags.any(axis=1) & (p["n"].to_numpy() == 1)):
                start = int(place[i]) >> 20
                rows += [(p["k1"].iat[i], p["k2"].iat[i], start + a, start + z) for a, z in _spans(flags[i])]
            return pd.DataFrame(rows, columns=["k1", "k2", "low", "high"])

        size = 0
        for b in batches:
            if not len(b):
                continue
            h = b["h"].to_numpy()
            for lo, hi in _whole(h):
                part = b.iloc[lo:hi]
                if held and size + len(part) > BLOCK and held[-1]["h"].iat[-1] != h[lo]:
                    yield solve()
                    size = 0
                held.append(part)
                size += len(part)
        if held:
            yield solve()

    return run


def _whole(h: np.ndarray) -> list[tuple[int, int]]:
    """Slices of adjacent equal keys, small ones together."""
    edge = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
    out, low = [], 0
    for a, z in zip(edge[1:], edge[2:] + [edge[-1]]):
        if z - low > 1024 or a == len(h):
            out.append((low, a))
            low = a
    return [(a, z) for a, z in out if z > a]


# ------------------------------------------------------------------ tables

def _packed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """(k1, k2, extra..., z): texts compressed before they are shuffled."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = b[["k1", "k2", *extra]].copy()
            out["z"] = [pack.compress(bytes(t)) for t in b["data"]]
            yield out

    schema = ", ".join(f"{c} {fields[c]}" for c in ["k1", "k2", *extra])
    return docs.mapInPandas(run, f"{schema}, z binary")


def _unpack(z: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(bytes(z))


#: Runs or strings handed on at a time.
ROWS = 20_000


def _read_contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = ["k1", "k2", "h", "c", "n", "place", "many", "context"], []
        for b in batches:
            for k1, k2, z, runs in zip(b["k1"], b["k2"], b["z"], b["runs"]):
                data = _unpack(z)
                for r in runs:
                    place = r["place"]
                    start, n = place >> 20, (place >> 10) & 1023
                    rows.append((k1, k2, r["h"], r["c"], r["n"], place, r["many"], data[start:start + n + length - 1]))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _string_hashes(length: int):
    """Rows (h, at, s1, s2, k1, k2, start, n): each string of a run by its distance from the anchor and its hash."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS // 100):  # a run has length strings at most
                p = b.iloc[at:at + ROWS // 100]
                place = p["place"].to_numpy()
                n = (place >> 10) & 1023
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s = np.frombuffer(b"".join(xxh3_128_digest(data[j:j + length]) for data, m in zip(map(bytes, p["context"]), n.tolist())
                                           for j in range(m)), "<i8").reshape(-1, 2)
                every = {c: np.repeat(p[c].to_numpy(), n) for c in ("h", "k1", "k2", "n")}
                yield pd.DataFrame({"h": every["h"], "at": np.repeat(place & 1023, n) - i, "s1": s[:, 0], "s2": s[:, 1],
                                    "k1": every["k1"], "k2": every["k2"], "start": np.repeat(place >> 20, n) + i, "n": every["n"]})

    return run


def repeated_starts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, low, high): ranges of starts of repeated strings, of ``docs`` (k1, k2, data)."""
    row = "k1 long, k2 long, h long, c long, place long"
    runs = materialize(docs.select("k1", "k2", "data").mapInPandas(_find_runs(length, gram), row), "runs")
    one = ["k1", "k2", "place"]  # tells runs apart
    # common anchors, runs and strings hold any share of the rows: these joins cut them by their counts
    twice = materialize(runs.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "anchors-twice")
    cand = materialize(join_counted(runs, twice, ["h"], "m", one).drop("m"), "repeated-anchors")
    alike = materialize(cand.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")),
                        "runs-alike")
    whole = join_counted(cand, alike.where("n > 1").select("h", "c", "n"), ["h", "c"], "n", one).select(
        "k1", "k2", F.expr("shiftright(place, 20)").alias("low"),
        F.expr("shiftright(place, 20) + (shiftright(place, 10) & 1023) - 1").alias("high"))

    # collections with a run that has no equal
    mixed = materialize(alike.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
                        .where("m > 1 and least = 1").drop("least"), "anchors-mixed")
    wanted = (join_counted(alike, mixed, ["h"], "m", ["c"])
              .select("one.k1", "one.k2", "h", "c", "n", F.col("one.place").alias("place"), (F.col("m") > GROUP).alias("many"))
              .groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "n", "place", "many")).alias("runs")))
    row = "k1 long, k2 long, h long, c long, n long, place long, many boolean, context binary"
    contexts = (_packed(docs.select("k1", "k2", "data"), []).join(wanted.hint("shuffle_hash"), ["k1", "k2"])
                .mapInPandas(_read_contexts(length), row))
    # a document that stands in several rows gives its runs as often
    contexts = materialize(contexts, "run-contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = (contexts.where("not many").dropDuplicates(["h", "c"]).repartition(parts, "h").sortWithinPartitions("h", "c")
           .mapInPandas(_sort_columns(length), "k1 long, k2 long, low long, high long"))
    single = contexts.where("many").dropDuplicates(["h", "c"]).mapInPandas(
        _string_hashes(length), "h long, at long, s1 long, s2 long, k1 long, k2 long, start long, n long")
    single = materialize(single, "single-strings")
    string = ["h", "at", "s1", "s2"]
    again = materialize(single.groupBy(*string).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "strings-again")
    many = (join_counted(single.where("n = 1"), again, string, "m", ["k1", "k2", "start"])
            .select("k1", "k2", F.col("start").alias("low"), F.col("start").alias("high")))
    return whole.unionByName(few).unionByName(many)


def _remove(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, z, ranges in zip(b["key"], b["z"], b["ranges"]):
                data = _unpack(z)
                cuts: list[list[int]] = []
                for r in sorted(ranges, key=lambda r: r["low"]) if ranges is not None else ():
                    if cuts and r["low"] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], r["high"] + length)
                    else:
                        cuts.append([r["low"], r["high"] + length])
                at = [0, *(x for c in cuts for x in c), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(at[::2], at[1::2]))
                rows.append((key, len(data), len(data) - len(kept), len(cuts), kept, [{"start": i, "end": j} for i, j in cuts]))
            yield pd.DataFrame(rows, columns=["key", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans) for each row: its UTF-8 bytes without those
    covered by a string of ``length`` bytes that also starts anywhere else in ``docs``.

    ``spans`` are the maximal removed (start, end) byte ranges. Null texts count as empty; texts shorter
    than ``length`` never change. Strings are judged on the input, all their occurrences go, overlapping
    ones and those in one document included; matches don't cross rows. Rows that repeat id and text repeat all
    their strings. Cuts may fall inside a character. An empty table gives an empty result; other columns are not read.
    """
    if not 0 < gram < length or length > 500:
        raise ValueError("a gram is shorter than a string, a string 500 bytes at most")
    kind = docs.schema[id_col].dataType
    text = utf8(F.col(text_col))
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(3), text_col, id_col).alias("k2"),
                        F.col(id_col).cast("string").alias("key"), text.alias("data"))
    ranges = (repeated_starts(keyed, length, gram).groupBy("k1", "k2")
              .agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
    ranges = materialize(ranges, "repeated-ranges")
    out = _packed(keyed, ["key"]).join(ranges.hint("shuffle_hash"), ["k1", "k2"], "left").select("key", "z", "ranges")
    row = "key string, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    return out.mapInPandas(_remove(length), row).withColumn("doc_id", F.col("key").cast(kind)).drop("key")
