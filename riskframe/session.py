"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "riskframe",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("RISKFRAME_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Intermediate tables of this process that are still there.
_WRITTEN: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private folder created.
    Iterative operators cut lineage with ``DataFrame.checkpoint()`` into this
    folder, which on a cluster is shared storage, so a lost executor never
    loses a checkpointed round.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.startswith("local"):
            conf_dir = fallback or tempfile.mkdtemp(prefix="riskframe-ckpt-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df, tag: str = "t"):
    """Cut lineage by writing ``df`` as parquet into the shared checkpoint folder
    and reading it back (one computation, unlike an un-persisted reliable
    ``checkpoint()``, which computes its input twice)."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/riskframe-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written so far; returns how many.

    To be called once the results that read them are written: a DataFrame that still
    depends on one of them fails afterwards."""
    n = 0
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n
