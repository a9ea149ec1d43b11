"""A saved model on a stream: each micro-batch runs the batch job's whole plan.

Imputation, forest gate and calibrated folds need joins that a streaming plan can't hold, so batches go through
``foreachBatch``. A batch writes folders named by its id, then an entry of the commit log. Run again after
a crash it writes the same folders anew, or nothing where its entry is there; ``read_scored`` takes batches
with an entry only. So a row is never there twice, and never half a batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.plans.model_store import publish_file
from riskframe.session import ensure_checkpoint_dir, materialize
from riskframe.sources.patients import NA_TOKENS, normalize_missing
from riskframe.sources.sinks import path_exists


def parse_records(lines: DataFrame, schema: T.StructType, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, (value, reason) of the rest) of lines that hold one JSON object each.

    A line is set aside when it is no JSON object, lacks a required column, or has a value that its column's
    type can't hold and that isn't a missing-value token. Blank lines are skipped."""
    lines = lines.where(F.trim("value") != "").withColumn("_m", F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), F.map_keys("_m"))
    typed, wrong = [], []
    for f in schema.fields:
        raw = F.col("_m")[f.name]
        value = F.when(~raw.isin(NA_TOKENS), raw).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        wrong.append(F.when(~raw.isin(NA_TOKENS) & value.isNull(), F.lit(f"bad {f.name}")))
    reason = F.when(F.col("_m").isNull(), F.lit("not a JSON object")).otherwise(
        F.concat_ws("; ", F.when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ", "))), *wrong))
    lines = lines.withColumn("reason", reason)
    return normalize_missing(lines.where("reason = ''").select(*typed)), lines.where("reason <> ''").select("value", "reason")


def write_batch(lines: DataFrame, batch: int, schema: T.StructType, required: Sequence[str],
                score: Callable[[DataFrame], DataFrame], out: str) -> bool:
    """Score one batch and commit it; False if it was committed before."""
    spark, base = lines.sparkSession, out.rstrip("/")
    entry = f"{base}/commits/{batch:012d}.json"
    if path_exists(spark, entry):
        return False
    rows, aside = parse_records(materialize(lines.select("value"), "stream-batch"), schema, required)
    score(rows).write.mode("overwrite").parquet(f"{base}/scored/batch={batch}")
    aside.write.mode("overwrite").parquet(f"{base}/quarantine/batch={batch}")
    return publish_file(spark, entry, json.dumps({"batch": batch}))


def score_stream_batches(spark: SparkSession, source_dir: str, schema: T.StructType, required: Sequence[str],
                         score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str | None = None,
                         available_now: bool = True, files_per_batch: int = 1000):
    """Score files of JSON lines as they land in ``source_dir``; returns the StreamingQuery (finished when available_now)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # the same sink has the same checkpoint in every process
    ckpt = checkpoint or f"{base}/stream-{hashlib.sha256(out.encode()).hexdigest()[:32]}"
    source = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source_dir)
    w = source.writeStream.option("checkpointLocation", ckpt).foreachBatch(
        lambda lines, batch: write_batch(lines, batch, schema, required, score, out) and None)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q


def _committed(spark: SparkSession, out: str, part: str) -> DataFrame:
    base = out.rstrip("/")
    done = spark.read.schema("batch long").json(f"{base}/commits")
    rows = spark.read.parquet(f"{base}/{part}")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """Scores of the committed batches, with ``batch``."""
    return _committed(spark, out, "scored")


def read_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """(value, reason, batch): lines of the committed batches that were set aside."""
    return _committed(spark, out, "quarantine")
