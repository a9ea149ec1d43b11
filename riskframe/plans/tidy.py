"""Output normalisation shared by every registered query.

Integral columns become bigint and fractional ones double rounded to 6
decimals, so results compare exactly with the SQL oracle regardless of the
order in which partial sums were combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _INTEGRAL):
            c = c.cast("bigint")
        elif isinstance(f.dataType, _FRACTIONAL):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("boolean")
        cols.append(c.alias(f.name))
    return df.select(*cols)
