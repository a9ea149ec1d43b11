"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskframe.session import ensure_checkpoint_dir, materialize

__all__ = ["materialize", "scratch_path", "utf8", "row_identity", "dense_numbers", "join_counted", "wide"]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def utf8(col):
    """UTF-8 bytes of a text, a null counting as empty."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def row_identity(*cols):
    """A 16-byte identity of the given columns' values, nulls told from empty texts.
    Rows that agree in all of them share it."""
    parts = [F.concat(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(c.cast("string"), F.lit("")))
             for c in map(F.col, cols)]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def wide(spark: SparkSession) -> int:
    """Number of buckets by which a hot key is cut: some for each shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_numbers(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each value of ``keys`` (all rows if none).

    A key may hold any share of the rows: rows are cut into hash buckets of
    ``order``, numbered inside (key, bucket), and shifted by the sizes of the
    key's earlier buckets, a table with at most ``wide()`` rows per key. ``df``
    is read twice, so it should be a written table. Rows that tie in ``order``
    are numbered in any order.
    """
    n = wide(df.sparkSession)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    on = [*keys, "_b"]
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*on, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1
    return (df.withColumn("_i", inside).join(shift, on)
            .withColumn(out, F.col("_i").cast("long") + F.col("_shift")).drop("_b", "_i", "_shift"))


#: Rows of one key that one task of a join may always take.
TASK_ROWS = 10_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, a written table of one row per key whose ``count`` says how many
    rows the key has.

    A key above the fair share, the rows of all keys over ``wide()`` (or TASK_ROWS if that is more), is cut into
    that many times the share: its rows by a hash of ``spread``, its row of ``keys`` once for each cut. Fewer than
    ``wide()`` keys can be above the share, so their table is broadcast.
    """
    n = wide(rows.sparkSession)
    share = max(TASK_ROWS, int(keys.agg(F.sum(count)).first()[0] or 0) // n)
    hot = F.broadcast(keys.where(F.col(count) > share).select(*on, F.ceil(F.col(count) / share).cast("int").alias("_cuts")))
    cuts = F.coalesce("_cuts", F.lit(1))
    rows = rows.join(hot, on, "left").withColumn("_cut", F.pmod(F.xxhash64(*spread), cuts).cast("int")).drop("_cuts")
    keys = keys.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
    return rows.join(keys, [*on, "_cut"]).drop("_cut")
