"""Versions of a saved model, switched by numbered manifests.

A training run writes a folder of its own below ``versions``; only when all its parts are there does the next
manifest name it. A manifest appears whole, by a rename, and is never changed, so a run that dies half-way leaves
the version before it in use, and a reader that has opened a version keeps it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole under a name that isn't taken; False if it is."""
    folder, name = path.rsplit("/", 1)
    target, fs = _fs(spark, path)
    temp, _ = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
    if fs.exists(target):
        return False
    out = fs.create(temp)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(temp, target))


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that don't start with a dot or an underscore, in order; none if there is no folder."""
    p, fs = _fs(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n[0] not in "._")


def new_version(model_dir: str) -> str:
    """A folder for the parts of a version that isn't in use yet."""
    return f"{model_dir.rstrip('/')}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, model_dir: str, version: str, **about) -> None:
    """Put a whole version into use."""
    folder = f"{model_dir.rstrip('/')}/manifests"
    text = json.dumps({"version": version.rsplit("/", 1)[1], **about})
    taken = True
    while taken:  # a run that publishes at the same time takes the number before or after
        number = max([int(n.split(".")[0]) for n in file_names(spark, folder)], default=0) + 1
        taken = not publish_file(spark, f"{folder}/{number:09d}.json", text)


def current(spark: SparkSession, model_dir: str) -> str:
    """The folder of the version in use."""
    base = model_dir.rstrip("/")
    names = file_names(spark, f"{base}/manifests")
    if not names:
        raise FileNotFoundError(f"no published model below {model_dir}")
    return f"{base}/versions/{spark.read.json(f'{base}/manifests/{names[-1]}').first()['version']}"
