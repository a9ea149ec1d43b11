"""Removal of repeated three-line windows.

Each window of ``window`` consecutive lines is hashed (128 bits); the first occurrence
of a window in the corpus, by (doc_id, row, line), stays, and every later one is
removed: the lines that its occurrences cover, merged, leave the document. A removed
line always stands in an earlier place that is kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, row_identity


def _window_hashes(text: Column, window: int) -> Column:
    """(pos, h1, h2) for each window that isn't blank throughout."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def each(ls):
        starts = F.when(F.size(ls) >= window, F.sequence(F.lit(0), F.size(ls) - window)).otherwise(
            F.array().cast("array<int>"))

        def one(i):
            run = F.slice(ls, i + 1, window)
            return F.struct(i.alias("pos"), F.xxhash64(run).alias("h1"), F.xxhash64(F.lit(1), run).alias("h2"),
                            F.exists(run, lambda x: F.trim(x) != "").alias("said"))
        return F.filter(F.transform(starts, one), lambda x: x["said"])
    return F.transform(F.array(lines), each)[0]


def _keep_lines(window: int):
    @F.pandas_udf("text string, n_lines long, n_removed long")
    def keep(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, later in zip(text, starts):
            if t is None:
                rows.append((None, 0, 0))
                continue
            lines = t.split("\n")
            if later is None or not len(later):
                rows.append((t, len(lines), 0))
                continue
            gone = {p + d for p in later for d in range(window)}
            left = [x for i, x in enumerate(lines) if i not in gone]
            rows.append(("\n".join(left), len(lines), len(lines) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])
    return keep


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows of lines removed from ``text_col``, and a struct column
    ``line_dedup`` (n_lines, n_removed). All other columns stay as they are.

    Lines end at a line feed and are compared exactly; windows of blank lines only don't count,
    documents of fewer than ``window`` lines never change. Null texts stay null (0 lines); an empty
    text is one empty line. Order is by id (nulls last), then by a hash of the text; rows that agree in
    id and text are one document and come out alike. A document all of whose lines repeat
    earlier ones keeps its row with an empty text. An empty table gives an empty result. A
    column of ``docs`` that is called ``line_dedup`` is replaced.
    """
    key = row_identity(id_col, text_col)
    seen = docs.select(F.col(id_col).alias("id"), key.alias("row_key"),
                       F.inline(_window_hashes(F.col(text_col), window)))
    seen = materialize(seen.drop("said"), "line-windows")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row_key"), F.col("pos"))
    seen = seen.select("row_key", "pos", "h1", "h2", place.alias("place"))
    firsts = (seen.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("final"))
              .where("first != final").select("h1", "h2", "first"))
    later = (seen.join(firsts, ["h1", "h2"]).where("place != first")
             .groupBy("row_key").agg(F.collect_set("pos").alias("_starts")))
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no clash with the columns joined on
    text = f"c{names.index(text_col)}"
    numbered = numbered.withColumn("row_key", row_identity(f"c{names.index(id_col)}", text))
    done = numbered.join(later, "row_key", "left").withColumn("_kept", _keep_lines(window)(F.col(text), F.col("_starts")))
    out = [F.col("_kept.text").alias(n) if f"c{i}" == text else F.col(f"c{i}").alias(n)
           for i, n in enumerate(names) if n != "line_dedup"]
    return done.select(*out, F.struct(F.col("_kept.n_lines").alias("n_lines"),
                                      F.col("_kept.n_removed").alias("n_removed")).alias("line_dedup"))
