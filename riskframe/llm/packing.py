"""Packing token pieces into fixed windows by minimum bin slack.

Documents are tokenised and cut into full windows plus one remainder each. The
remainders are packed by length: only the table (length, how many), at most
``capacity - 1`` rows, comes to the driver. Each window is opened with the longest
remaining length; a bitset subset-sum over the other remaining lengths (with their
counts) finds the multiset that fills it closest to capacity, and backtracking
gives its counts. The same multiset is repeated while the counts last, so the
number of searches depends on ``capacity`` alone. Remainders then take their place
by their rank among the remainders of their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import dense_numbers, materialize

#: Documents tokenised at a time.
STEP = 256


# ------------------------------------------------------------------ tokens

#: Fixed value: the byte-level pre-token pattern, with possessive repeats where nothing can be given back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODINGS: dict[str, object] = {}


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_bpe(path: str):
    """The byte-level BPE of a tokenizers JSON file (no normaliser, byte-level pre-tokens, ids in merge order)
    as a tiktoken encoding, which gives the same ids in less time. One per process."""
    if path not in _ENCODINGS:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODINGS[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): every document's ids, closed by ``end_id``, cut
    into windows of ``capacity`` and a shorter rest. ``ids`` holds little-endian unsigned 32-bit ids.

    A null text counts as empty, and so gives the one piece [end_id]. Repeated rows
    give repeated pieces; an empty table gives none.
    """
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), STEP):
                ids, texts = batch["doc_id"].iloc[at:at + STEP], batch["text"].iloc[at:at + STEP].fillna("")
                rows = []
                for doc, text in zip(ids, texts):
                    data = bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() + end
                    n = len(data) // 4
                    rows += [(doc, s, min(capacity, n - s), n, data[4 * s:4 * (s + capacity)])
                             for s in range(0, n, capacity)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
                yield out.astype({"doc_id": "Int64"})

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


# ------------------------------------------------------------------ minimum bin slack

def fill_window(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths (within their counts) whose sum comes closest to ``target`` from below."""
    if target <= 0:
        return {}
    mask, want, reach, stages = (1 << (target + 1)) - 1, 1 << target, 1, []
    for length in sorted((n for n in counts if n <= target), reverse=True):
        before, left, step = reach, min(counts[length], target // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left, step = left - step, step * 2
        stages.append((length, before))
        if reach & want:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        k = 0
        while not (before >> at) & 1:
            at, k = at - length, k + 1
        if k:
            chosen[length] = k
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: count}) patterns that use up ``counts``, each window filled as far as can be."""
    counts, patterns = {n: c for n, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = fill_window({n: c for n, c in rest.items() if c}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        patterns.append((times, chosen))
        for n, k in chosen.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return patterns


def _places(patterns) -> tuple[list[tuple], int]:
    """(length, from rank, to rank, count in a window, first window, offset in it) rows, and the windows used."""
    rows, used, window = [], {}, 0
    for times, chosen in patterns:
        offset = 0
        for n in sorted(chosen, reverse=True):
            low = used.get(n, 0)
            used[n] = low + times * chosen[n]
            rows.append((n, low, used[n], chosen[n], window, offset))
            offset += n * chosen[n]
        window += times
    return rows, window


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (doc_id, start, length, ...).

    Sequences are numbered gaplessly from 0: first those packed from shorter pieces, then
    the full ones. Offsets are gapless in each sequence. No piece is cut.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < capacity)
    counts = {r[0]: r[1] for r in short.groupBy("length").count().collect()}  # at most capacity - 1 rows
    rows, packed = _places(minimum_slack(counts, capacity))
    table = spark.createDataFrame(rows, "length long, _from long, _to long, _each long, _first long, _at long")
    if len(rows) <= 200_000:  # 48 bytes a row
        table = F.broadcast(table)
    keep = pieces.columns
    ranked = dense_numbers(short, ["length"], ["doc_id", "start"], "_rank")
    short = ranked.join(table, "length").where("_rank >= _from and _rank < _to").select(
        *keep, F.expr("_first + (_rank - _from) div _each").alias("sequence_id"),
        F.expr("_at + ((_rank - _from) % _each) * length").alias("offset"))
    full = dense_numbers(pieces.where(F.col("length") == capacity), [], ["doc_id", "start"], "_rank").select(
        *keep, (F.col("_rank") + packed).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0,
                   keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: (doc_id, start, length, doc_tokens, ids_crc32[, ids], sequence_id, offset).
    Nulls, empty texts, repeated rows and empty tables as in ``token_pieces``; other columns are not read."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    return pack_pieces(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)
