"""Column types: how they are stored, and which values they take."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    stored: T.DataType
    low: int | None = None
    high: int | None = None
    bytes: int | None = None

    @property
    def is_text(self) -> bool:
        return isinstance(self.stored, T.StringType)


KINDS = {
    "TINYINT": Kind(T.ByteType(), -(1 << 7), (1 << 7) - 1),
    "SMALLINT": Kind(T.ShortType(), -(1 << 15), (1 << 15) - 1),
    "INT": Kind(T.IntegerType(), -(1 << 31), (1 << 31) - 1),
    "BIGINT": Kind(T.LongType(), -(1 << 63), (1 << 63) - 1),
    "UTINYINT": Kind(T.ShortType(), 0, (1 << 8) - 1),
    "USMALLINT": Kind(T.IntegerType(), 0, (1 << 16) - 1),
    "UINT": Kind(T.LongType(), 0, (1 << 32) - 1),
    "UBIGINT": Kind(T.DecimalType(20, 0), 0, (1 << 64) - 1),
    "FLOAT": Kind(T.FloatType()),
    "DOUBLE": Kind(T.DoubleType()),
    "CHAR": Kind(T.StringType(), bytes=255),
    "VARCHAR": Kind(T.StringType(), bytes=8000),
}


def kind_of(stored: T.DataType) -> str:
    """The dialect's name for a foreign column's type; VARCHAR for what has none."""
    names = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE"}
    return names.get(type(stored), "VARCHAR")


def field(name: str, kind: str, key: bool = False) -> T.StructField:
    return T.StructField(name, KINDS[kind].stored, True, {"logical_type": kind, "pk": key})


def parsed(text: Column, kind: str, check_size: bool = True) -> Column:
    """A text cell as a value of the type, or null where it is none."""
    k = KINDS[kind]
    if k.is_text:
        return F.when(F.octet_length(text) <= k.bytes, text) if check_size else text
    if k.low is None:
        return F.trim(text).try_cast(k.stored)
    wide = F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("decimal(38,0)"))
    return F.when((wide >= F.lit(Decimal(k.low))) & (wide <= F.lit(Decimal(k.high))), wide).cast(k.stored)


def value(text: str, kind: str):
    """A literal's text as a Python value of the type; ValueError where it is none."""
    k = KINDS[kind]
    if k.is_text:
        return text
    if k.low is None:
        return float(text)
    n = int(text)
    if not k.low <= n <= k.high:
        raise ValueError(f"{text} is out of range for {kind}")
    return Decimal(n) if isinstance(k.stored, T.DecimalType) else n
