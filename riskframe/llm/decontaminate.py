"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document and a benchmark item that share ``span`` words in a row share every run of
``k`` words in them. Of each ``span - k + 1`` consecutive k-gram hashes the smallest is
kept on both sides, so the same one is kept in both copies of the span: joining the
kept hashes finds a document of every shared span. Around the hits, windows of
``span`` words are then compared word by word with the windows of the items.
Items shorter than ``span`` are one window of their own length, which winnowing can't
promise to find; documents are searched for them by all their runs of that length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, row_identity

#: Hashes up to which the benchmark's side of a join is broadcast (16 bytes each); beyond, it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words(col: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z; none for null."""
    low = F.translate(F.coalesce(col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, though ``fn`` uses it for each element."""
    return F.transform(F.array(value), fn)[0]


def _runs(values: Column, length: int, fn) -> Column:
    """``fn`` of each run of ``length`` consecutive elements (none if there are fewer)."""
    starts = F.when(F.size(values) >= length, F.sequence(F.lit(1), F.size(values) - (length - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: fn(F.slice(values, i, length)))


def gram_hashes(text_words: Column, k: int) -> Column:
    """XXH64 of each run of ``k`` words."""
    return _bind(F.transform(text_words, lambda w: F.xxhash64(w)), lambda h: _runs(h, k, lambda r: F.xxhash64(r)))


def winnowed(text_words: Column, k: int, span: int) -> Column:
    """The distinct hashes that are smallest in one of the windows of ``span - k + 1`` k-grams."""
    def kept(h):
        return F.array_distinct(_runs(h, span - k + 1, F.array_min))
    return _bind(gram_hashes(text_words, k), kept)


def _checked_broadcast(df: DataFrame, rows: int, text_bytes: int = 0) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and text_bytes <= BROADCAST_BYTES else df


def _item_windows(items: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """(len, words, items): the distinct windows of the items with the ids that hold them."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(span)))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
                       lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))
    return (w.select("item", "len", F.explode(F.array_distinct(each)).alias("words"))
            .groupBy("len", "words").agg(F.collect_set("item").alias("items")))


def _covered(intervals: Column) -> Column:
    """How many words sorted (start, len) intervals cover together."""
    return F.aggregate(
        intervals, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n"),
                              F.greatest(a["end"], x["start"] + x["len"]).alias("end")),
        lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (doc_id, row_key, n_words, n_hit, item_ids, spans). ``item_ids`` holds the ids, as
    strings in order, of the items with a window in the document, ``spans`` the hit (start, len) word windows
    and ``n_hit`` how many words they cover.

    Null or empty texts have no words and no hits; items without words are ignored, a null
    item id counts as an empty one. Rows that agree in id and text are the same document
    and get the same result each; rows with a null id are told apart by their text. Items that
    repeat a text each count. Empty tables give an empty result, or no hits. Other columns
    are not read. ``row_key`` identifies (id, text).
    """
    w = words(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_identity(id_col, text_col).alias("row_key"), w.alias("w"))
    wins = _item_windows(items, span, item_id_col, item_text_col).withColumn("number", F.monotonically_increasing_id())
    wins = materialize(wins, "item-windows")  # numbers as written
    n_wins, n_bytes = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    shorts = sorted(r[0] for r in wins.where(F.col("len") < span).select("len").distinct().collect())  # below span

    # hashes kept of the items' long windows: those of a window of exactly ``span`` words
    grams = F.array_min(gram_hashes(F.split("words", " "), k))
    marks = materialize(wins.where(F.col("len") == span).select(grams.alias("h")).distinct(), "item-marks")
    marks = _checked_broadcast(marks, n_wins)
    base = materialize(keyed.select("doc_id", "row_key", F.size("w").alias("n_words"),
                                    winnowed(F.col("w"), k, span).alias("kept")), "doc-marks")
    hits = base.select("row_key", F.explode("kept").alias("h")).join(marks, "h").select("row_key", "h")
    if shorts:
        whole = F.flatten(F.array(*[F.array_distinct(gram_hashes(F.col("w"), n)) for n in shorts]))
        own = wins.where(F.col("len") < span).select(
            F.coalesce(*[F.when(F.col("len") == n, gram_hashes(F.split("words", " "), n)[0]) for n in shorts]).alias("h"))
        found = keyed.select("row_key", F.explode(whole).alias("h")).join(_checked_broadcast(own.distinct(), n_wins), "h")
        hits = hits.unionByName(found.select("row_key", "h"))
    hits = materialize(hits.distinct(), "doc-hits")

    # extend: windows around the places of the hits, compared word by word
    found_in = materialize(hits.select("row_key").distinct(), "docs-hit")
    found_in = _checked_broadcast(found_in, found_in.count())  # else texts are shuffled, not their words
    near = docs.select(row_identity(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(found_in, "row_key")
    near = near.dropDuplicates(["row_key"]).select("row_key", words(F.col("text")).alias("w"))
    near = materialize(near, "doc-near")  # texts with hits alone

    def starts(n: int, grams_in: int, size: int) -> DataFrame:
        """(row_key, size, starts): where windows of ``size`` words begin of which one of ``n`` grams is hit."""
        grams = near.select("row_key", F.size("w").alias("words"), F.posexplode(gram_hashes(F.col("w"), grams_in)).alias("at", "h"))
        at = grams.join(hits, ["row_key", "h"])  # places, from 0
        first, last = F.greatest(F.lit(0), F.col("at") - (n - 1)), F.least(F.col("at"), F.col("words") - size)
        at = at.where(first <= last).select("row_key", F.explode(F.sequence(first, last)).alias("start"))
        return at.groupBy("row_key").agg(F.collect_set("start").alias("starts")).withColumn("size", F.lit(size))

    begun = starts(span - k + 1, k, span)
    for n in shorts:
        begun = begun.unionByName(starts(1, n, n))
    window = F.transform("starts", lambda i: F.struct(i.cast("long").alias("start"), F.col("size").cast("long").alias("len"),
                                                      F.array_join(F.slice("w", i + 1, F.col("size")), " ").alias("words")))
    cand = near.join(begun, "row_key").select("row_key", F.inline(window))
    known = wins.select(F.col("len").cast("long").alias("len"), "words", "number")
    sure = materialize(cand.join(_checked_broadcast(known, n_wins, n_bytes), ["len", "words"]).drop("words"), "doc-windows")
    ids = sure.select("row_key", "number").distinct().join(wins.select("number", F.explode("items").alias("item")), "number")
    ids = ids.select("row_key", "item").distinct().groupBy("row_key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    per_doc = sure.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans")).join(ids, "row_key")
    per_doc = per_doc.withColumn("n_hit", _covered(F.col("spans")))
    none = F.array().cast("array<string>")
    return base.drop("kept").join(per_doc, "row_key", "left").select(
        "doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans")
