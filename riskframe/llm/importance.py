"""Target-distribution importance resampling over hashed word runs, with a head-tail vocabulary.

Every run of up to ``longest`` words is a feature; its bucket is the CRC-32 of its bytes modulo
the number of buckets. The CRC of a longer run goes on from the state of the shorter one. Words
that are frequent in the documents (the head) have their states, frequent pairs their buckets, in
tables of bounded size that every task gets; all other words and runs (the tail) take the CRC
directly. Both ways give the same numbers, so the bucket totals and weights are exact whatever the
head holds: it only saves work.

The head comes from bounded summaries of all documents: a task counts words and, when its
table is full, lowers all counts until half of it goes, so words with a large share stay.
Bucket totals are added up inside tasks as vectors, so a shuffle holds at most (tasks x buckets)
numbers. Weights are the floored mean of the bucket gains over a document's features; adding
noise drawn from a hash of the id and taking the greatest scores draws without replacement in
proportion to exp(weight / 1000). Ranks come from ranges of the score, numbered inside and shifted.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import materialize

#: Entries of the head tables, bytes of a head word at most, entries of a task's summary.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES, SUMMARY = 32_768, 65_536, 48, 200_000
#: Features turned into bucket numbers at a time.
STEP = 1 << 20

#: Bytes of words stand for themselves (A-Z in lower case), all others for a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes: runs of digits, letters a-z (A-Z folded) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Head:
    """CRC states of frequent words and, for pairs of words, buckets."""

    def __init__(self, words: Sequence[bytes] = (), pairs: Sequence[tuple[bytes, bytes]] = (), buckets: int = 10_000) -> None:
        self.buckets = buckets
        self.states = {w: zlib.crc32(w) for w in words}
        self.pairs = {(a, b): zlib.crc32(b" " + b, zlib.crc32(a)) % buckets for a, b in pairs}

    def features(self, words: list[bytes], longest: int) -> list[int]:
        """Bucket numbers of all runs of 1 to ``longest`` words, repeats included."""
        state, crc, buckets = self.states.get, zlib.crc32, self.buckets
        at = [s if (s := state(w)) is not None else crc(w) for w in words]
        out = [s % buckets for s in at]
        for k in range(2, longest + 1):
            after = words[k - 1:]
            if k == 2 == longest:
                pair = self.pairs.get
                out += [b if (b := pair((p, w))) is not None else crc(b" " + w, s) % buckets for p, w, s in zip(words, after, at)]
            else:
                at = [crc(b" " + w, s) for w, s in zip(after, at)]
                out += [s % buckets for s in at]
        return out


def _lower(counts: Counter, size: int) -> Counter:
    """At most ``size`` entries: the entry in the middle's count is taken off all."""
    if len(counts) <= size:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) // 2)[len(counts) // 2])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def _summaries(pairs: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, twos = Counter(), Counter()
        for b in batches:
            for text in b["text"]:
                w = word_list(text)
                words.update(w)
                if pairs:
                    twos.update(zip(w, w[1:]))
                words, twos = _lower(words, SUMMARY), _lower(twos, SUMMARY)
        short = [(w, None, n) for w, n in words.items() if len(w) <= HEAD_BYTES]
        short += [(a, b, n) for (a, b), n in twos.items() if len(a) + len(b) <= HEAD_BYTES]
        short.sort(key=lambda x: -x[2])
        yield pd.DataFrame(short[:HEAD_WORDS + HEAD_PAIRS], columns=["word", "next", "n"])
    return run


def frequent_head(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> Head:
    """The head of the table's ``text`` column, from all rows."""
    found = texts.select("text").mapInPandas(_summaries(longest == 2), "word binary, next binary, n long")
    found = found.groupBy("word", "next").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "word", "next"]
    words = [bytes(r["word"]) for r in found.where("next is null").orderBy(*order).limit(HEAD_WORDS).collect()]
    pairs = []
    if longest == 2:
        pairs = [(bytes(r["word"]), bytes(r["next"])) for r in found.where("next is not null").orderBy(*order).limit(HEAD_PAIRS).collect()]
    return Head(words, pairs, buckets)


def _totals(head, longest: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, totals = head.value, np.zeros((2, buckets), np.int64)
        for b in batches:
            for side in (0, 1):
                held: list[int] = []
                for text in b["text"][b["side"] == side]:
                    held += own.features(word_list(text), longest)
                    if len(held) >= STEP:
                        totals[side] += np.bincount(held, minlength=buckets)
                        held = []
                if held:
                    totals[side] += np.bincount(held, minlength=buckets)
        side, bucket = np.nonzero(totals)
        yield pd.DataFrame({"side": side, "bucket": bucket, "n": totals[side, bucket]})
    return run


def bucket_gains(totals: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket, from (side, bucket, n) with side 0 for the
    documents and 1 for the target."""
    spark = totals.sparkSession
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).cast("double")
    each = spark.range(buckets).withColumnRenamed("id", "bucket").join(totals, "bucket", "left").groupBy("bucket").agg(
        side(0).alias("s"), side(1).alias("t"))
    whole = totals.agg(side(0).alias("s"), side(1).alias("t")).first()
    ratio = (F.col("t") + 1) * F.lit(whole["s"] + buckets) / ((F.col("s") + 1) * F.lit(whole["t"] + buckets))
    gains = np.zeros(buckets, np.int64)
    for r in each.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # one row per bucket
        gains[r["bucket"]] = r["gain"]
    return gains


def _ranks(df: DataFrame) -> DataFrame:
    """Add ``rank`` (from 1) by score, greatest first, then doc_id (nulls last), then row."""
    spark = df.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    parts = materialize(parts.withColumn("range", F.spark_partition_id()), "score-ranges")
    sizes = parts.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    shift = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return parts.withColumn("inside", inside).join(shift, "range").withColumn("rank", F.col("inside") + F.col("shift")).drop("inside", "shift", "range")


def importance_sample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
                      seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
                      carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, carried) for each row of ``docs``.

    ``weight`` is the floored mean of the gains of the row's features (0 without features) and ``score`` the weight
    plus noise from the first 32 bits of sha256 of ``seed:id``. Of the N rows with ``least_words`` words or more the
    floor(percent * N / 100) with the greatest scores (ties: smaller id) have a ``rank`` from 1 on, others null.
    ``carried`` is a struct of the columns named by ``carry`` (null if there are none), so their names can't clash.

    A null text has no words. A null id counts as an empty one in the hash and comes last among ties.
    Repeated rows are rows of their own. An empty target leaves all gains to the documents' shares; empty documents
    give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    head = spark.sparkContext.broadcast(frequent_head(texts, longest, buckets))
    both = texts.withColumn("side", F.lit(0)).unionByName(target.select(F.col(target_text_col).alias("text"), F.lit(1).alias("side")))
    totals = both.mapInPandas(_totals(head, longest, buckets), "side int, bucket int, n long")
    totals = materialize(totals.groupBy("side", "bucket").agg(F.sum("n").alias("n")), "bucket-totals")
    gains = spark.sparkContext.broadcast(bucket_gains(totals, buckets))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(column: pd.Series) -> pd.DataFrame:
        own, gain, out = head.value, gains.value, []
        for text in column:
            words = word_list(text)
            f = own.features(words, longest)
            out.append((len(words), len(f), int(gain[f].sum()) // len(f) if f else 0))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), weigh(F.col(text_col)).alias("f"), noise.alias("noise"), carried.alias("carried"))
    rows = rows.select("doc_id", "f.n_words", "f.n_features", "f.weight", (F.col("f.weight") + F.col("noise")).alias("score"), "carried")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "importance")  # numbers as written
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = _ranks(able).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank", "carried")
