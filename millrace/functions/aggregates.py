"""The five aggregates.  On empty input they give zeros; SUM and AVG work in double and leave texts out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aggregate(func: str, column: Column | None, stored: T.DataType | None) -> Column:
    if func == "count":
        return F.count(F.lit(1))
    numeric = isinstance(stored, T.NumericType)
    if func in ("sum", "avg"):
        if not numeric:
            return F.coalesce(F.max(F.lit(0.0)), F.lit(0.0))
        return F.coalesce((F.sum if func == "sum" else F.avg)(column.cast("double")), F.lit(0.0))
    found = (F.min if func == "min" else F.max)(column)
    if numeric:
        return F.coalesce(found, F.lit(0).cast(stored))
    return F.coalesce(found, F.lit("0")) if isinstance(stored, T.StringType) else found
