"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger
is a Parquet folder with one row per (blob, rule, rule version) that was ever scanned
and the spans found, empty lists included. A scan reads only contents whose blob has
a pair not yet in the ledger, once per blob however many paths and versions hold it,
and only for the missing rules; it appends its rows in one Spark commit. Findings are
then joined back to all paths by blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, utf8


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` are dropped. A change of any
    of these asks for a new ``version``."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in code points, leftmost first, not overlapping."""
        compiled = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The kinds of secrets. The hex rule asks for its 16 characters itself, as runs are maximal.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)

LEDGER = "blob binary, rule string, version int, spans array<struct<start:long,end:long>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All pairs scanned so far; an empty table where no scan has run yet."""
    return spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def _of(ledger: DataFrame, blobs: DataFrame) -> DataFrame:
    """The ledger's rows of these blobs, so that a scan costs what its blobs do."""
    return ledger.join(blobs.select("blob"), "blob", "left_semi")


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(blob, rules[k].name, rules[k].version,
                     [{"start": s, "end": e} for s, e in rules[k].spans(text)])
                    for blob, text, missing in zip(b["blob"], b["text"], b["missing"]) for k in missing]
            yield pd.DataFrame(rows, columns=["blob", "rule", "version", "spans"])

    return run


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path",
                  content_col: str = "content") -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return (path, blob, found) for each of its rows:
    ``found`` holds all spans of all ``rules`` as (start, number, rule, end), by start and then by
    the order of ``rules`` (``number``).

    Null contents count as empty. Repeated rows and equal contents are scanned once and each get
    their findings; a null path is a path like any other. Spans are code points, end exclusive;
    a content without findings has an empty list. An empty table adds nothing to the ledger.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(content_col), F.lit(""))
    held = versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(utf8(content), 256)).alias("blob"),
                           content.alias("text"))
    paths = materialize(held.select("path", "blob"), "blob-paths")
    table = spark.createDataFrame([(k, r.name, r.version) for k, r in enumerate(rules)],
                                  "number int, rule string, version int")  # the list of rules
    every = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))
                      for k, r in enumerate(rules)])
    first = materialize(paths.groupBy("blob").agg(F.min("path").alias("path")), "blob-first")
    known = _of(read_ledger(spark, ledger), first).select("blob", "rule", "version")
    missing = (first.select("blob", "path", F.inline(every)).join(known, ["blob", "rule", "version"], "left_anti")
               .groupBy("blob", "path").agg(F.sort_array(F.collect_set("number")).alias("missing")))
    same = (held["blob"] == missing["blob"]) & held["path"].eqNullSafe(missing["path"])
    unseen = held.join(missing.hint("shuffle_hash"), same).select(held["blob"], "text", "missing")
    # a path that repeats the same row gives the same findings again; one row per pair stays
    found = unseen.mapInPandas(_scanner(rules), LEDGER).dropDuplicates(["blob", "rule", "version"])
    found.write.mode("append").parquet(ledger)
    # put together per blob first, so that a text held by a third of all paths is put together once
    # (two scans at a time may both have written a pair: the set holds it once)
    spans = F.flatten(F.transform(F.collect_set(F.struct("number", "rule", "spans")), lambda r: F.transform(r["spans"], lambda x: F.struct(
        x["start"].alias("start"), r["number"].alias("number"), r["rule"].alias("rule"), x["end"].alias("end")))))
    blobs = (_of(read_ledger(spark, ledger), first).join(F.broadcast(table), ["rule", "version"])
             .groupBy("blob").agg(F.array_sort(spans).alias("found")))
    return paths.join(blobs, "blob").select("path", "blob", "found")
