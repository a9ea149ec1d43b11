"""File-stream scoring: JSON patient files → cascade → parquet.

Scoring is a narrow, stateless plan, so the batch function is reused as is on
a streaming DataFrame. ``trigger(availableNow=True)`` processes what is in the
folder and stops; the checkpoint location (in the shared checkpoint folder)
gives exactly-once output across restarts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.session import ensure_checkpoint_dir


def score_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                 score: Callable[[DataFrame], DataFrame], sink_dir: str, checkpoint: str | None = None,
                 available_now: bool = True, multiline: bool = False):
    """Start the stream; returns the StreamingQuery (already finished when available_now)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    # the same sink has the same checkpoint in every process: a restart goes on where the last run ended
    ckpt = checkpoint or f"{base}/stream-{hashlib.sha256(sink_dir.encode()).hexdigest()[:32]}"
    src = spark.readStream.schema(schema).option("multiLine", multiline).json(source_dir)
    out = score(src)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt) \
           .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
