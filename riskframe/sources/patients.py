"""Patient sources: CSV, JSON (object or list), literal records.

Schemas are always explicit (no inference pass over the data). Missing-value
tokens become SQL NULL: numeric columns parse them to NULL already, string
columns are normalised here, and NaN is mapped to NULL (in Spark NaN = NaN and
NaN sorts last, unlike pandas).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens a CSV reader treats as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalize_missing(df: DataFrame) -> DataFrame:
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.nanvl(c, F.lit(None).cast(f.dataType))
    return df.withColumns(out) if out else df


def scan_patients_csv(spark: SparkSession, path: str, schema: T.StructType, target: str | None = None,
                      drop: Sequence[str] = ()) -> DataFrame:
    """CSV with header → typed rows; NA tokens → NULL; rows with a NULL target
    dropped; id / pruned columns dropped when present."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("nanValue", "NaN").option("nullValue", "").csv(path))
    df = normalize_missing(df)
    if target:
        df = df.na.drop(subset=[target])
    return df.drop(*[c for c in drop if c in df.columns])


def json_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns that the JSON files themselves hold."""
    return spark.read.option("multiLine", True).json(path).columns


def scan_patients_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON object or a list of objects per file (multi-line), typed by schema."""
    return normalize_missing(spark.read.schema(schema).option("multiLine", True).json(path))


def rows_from_records(spark: SparkSession, records, schema: T.StructType) -> DataFrame:
    """Literal dict(s) → rows (single-patient scoring)."""
    if isinstance(records, dict):
        records = [records]
    names = [f.name for f in schema.fields]
    return normalize_missing(spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema))
