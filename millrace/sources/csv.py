"""CSV in (LOAD) and out (EXPORT)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.formats import csv_cell, shown
from millrace.functions.types import parsed
from millrace.sources.files import Files

#: Rows that types are inferred from.
SAMPLE = 10


class CsvError(ValueError):
    """A file that cannot be loaded."""


def _is_int(cell: str) -> bool:
    return bool(re.fullmatch(r"[+-]?\d+", cell)) and -(1 << 31) <= int(cell) < 1 << 31


def _is_float(cell: str) -> bool:
    return bool(re.fullmatch(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)", cell, re.IGNORECASE))


def infer(cells: list[str]) -> str:
    """INT if all non-blank cells are 32-bit whole numbers (or all are blank), FLOAT if all are numbers, else VARCHAR."""
    full = [c for c in (c.strip() for c in cells) if c]
    if all(map(_is_int, full)):
        return "INT"
    return "FLOAT" if all(map(_is_float, full)) else "VARCHAR"


def read_csv(spark: SparkSession, path: str, force: bool = False, key: str | None = None, quoted: bool = False) -> tuple[list[tuple[str, str]], DataFrame, Callable[[], tuple[int, int]]]:
    """Columns, the good rows, and what gives the numbers of rows taken and left out once these are written: one pass does it all.

    The first line names the columns.  Cells are split at commas without quoting (with `quoted`, by RFC 4180) and trimmed.  A row
    of another length fails the load, when the counts are asked for; rows with a cell that is not of its column's type, and later rows of a key, are left out."""
    if quoted:
        table = spark.read.option("header", "false").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
        rows = table.select(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in table.columns)).alias("cells"))
    else:
        rows = spark.read.text(path).select(F.split("value", ",", -1).alias("cells"))
    rows = rows.withColumn("n", F.monotonically_increasing_id())
    # the first rows of one file are those of its first partition, which is all that is read
    top = (rows if Files(spark).is_file(path) else rows.orderBy("n")).limit(SAMPLE + 1).collect()
    if not top:
        raise CsvError(f"{path} is empty")
    names = [c.strip() for c in top[0].cells]
    if len(set(names)) < len(names) or not all(names):
        raise CsvError("column names must be unique and not blank")
    if key is not None and key not in names:
        raise CsvError(f"no column {key}")
    body = rows.filter(F.col("n") != top[0].n)
    sample = [r.cells for r in top[1:]]
    if any(len(r) != len(names) for r in sample):
        raise CsvError(f"a row has other than {len(names)} cells")
    columns = [(name, "VARCHAR" if force else infer([r[i] for r in sample])) for i, name in enumerate(names)]
    seen, taken = Observation(), Observation()
    body = body.observe(seen, F.count(F.lit(1)).alias("total"), F.sum(F.when(F.size("cells") != len(names), 1).otherwise(0)).alias("ragged"))
    cells = body.select("n", *(parsed(F.trim(F.get("cells", F.lit(i))), kind).alias(f"v{i}") for i, (_, kind) in enumerate(columns)))
    good = F.lit(True)
    for i in range(len(columns)):
        good = good & F.col(f"v{i}").isNotNull()
    kept = cells.filter(good)
    if key is not None:
        own = f"v{names.index(key)}"
        kept = kept.withColumn("first", F.row_number().over(Window.partitionBy(own).orderBy("n"))).filter("first = 1")
    kept = kept.select(*(F.col(f"v{i}").alias(name) for i, name in enumerate(names))).observe(taken, F.count(F.lit(1)).alias("kept"))

    def counts() -> tuple[int, int]:
        if seen.get["ragged"]:
            raise CsvError(f"{seen.get['ragged']} rows have other than {len(names)} cells")
        return taken.get["kept"], seen.get["total"] - taken.get["kept"]

    return columns, kept, counts


def lines(df: DataFrame) -> Iterator[str]:
    yield ",".join(csv_cell(c) for c in df.columns) + "\n"
    single = [isinstance(f.dataType, T.FloatType) for f in df.schema.fields]
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield ",".join(csv_cell(shown(v, s)) for v, s in zip(row, single, strict=True)) + "\n"


def write_csv(df: DataFrame, path: str, block: int = 1 << 16) -> None:
    """One file, in the result's order; rows pass through the driver a partition at a time."""

    def blocks() -> Iterator[str]:
        held: list[str] = []
        size = 0
        for line in lines(df):
            held.append(line)
            size += len(line)
            if size >= block:
                yield "".join(held)
                held, size = [], 0
        yield "".join(held)

    Files(df.sparkSession).write(path, blocks())
