"""The session: statements in, DataFrames out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.dialect.lexer import DialectError
from millrace.dialect.nodes import Explain, Select
from millrace.dialect.parser import parse
from millrace.functions import types
from millrace.operators.changes import CHANGES
from millrace.plans.explain import steps
from millrace.plans.planner import Planner
from millrace.sources import csv
from millrace.sources.storage import RETENTION, StorageError, Store, Table


class Session:
    """root: where tables are stored; without it the session reads registered DataFrames only."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.store = Store(spark, root) if root is not None else None
        self.views: dict[str, DataFrame] = {}
        self.debugging = False

    def register(self, name: str, df: DataFrame) -> Session:
        """A DataFrame as a read-only table."""
        self.views[name] = df
        return self

    def register_folder(self, folder: str, names: list[str]) -> Session:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def _table(self, name: str) -> DataFrame | None:
        found = self.store.read(name) if self.store else None
        return found if found is not None else self.views.get(name)

    def _stored(self) -> Store:
        if self.store is None:
            raise StorageError("this session has no folder for tables")
        return self.store

    def _changing(self, change: Callable[[Store], int]) -> int:
        """In the open transaction, which an error leaves open, or in one of its own, which an error undoes."""
        store = self._stored()
        if store.open_txn is not None:
            return change(store)
        store.begin()
        try:
            n = change(store)
            store.commit()
            return n
        except BaseException:
            if store.open_txn is not None:
                store.rollback()
            raise

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    # statements

    def sql(self, text: str) -> DataFrame:
        """A SELECT or EXPLAIN as a DataFrame; the commands and changes at once, giving the number of rows."""
        command = text.strip().rstrip(";").strip()
        word = command.split(None, 1)[0].upper() if command else ""
        if word in ("BEGIN", "COMMIT", "ROLLBACK") and " " not in command:
            getattr(self, word.lower())()
            return self._count(0)
        if word == "INFO":
            return self.spark.createDataFrame([(self.info(),)], "info string")
        if word == "DEBUG":
            return self.catalog()
        if word == "LOAD":
            parts = command.split()
            if len(parts) not in (4, 5):
                raise DialectError("LOAD <table> <file> <force: 0 or 1> [key]")
            return self._count(self.load_csv(parts[1], parts[2], parts[3] == "1", parts[4] if len(parts) == 5 else None)[0])
        if word == "EXPORT":
            m = re.fullmatch(r"\S+\s+(\S+)\s+(.+)", command, re.DOTALL)
            if not m:
                raise DialectError("EXPORT <file> <select>")
            self.export(m[2], m[1])
            return self._count(0)
        s = parse(text)
        if isinstance(s, Explain):
            return self.spark.createDataFrame([(f"-->{x}",) for x in steps(s.statement)], "EXPLAIN string")
        if isinstance(s, Select):
            return Planner(self._table).select(s)
        return self._count(self._changing(lambda store: CHANGES[type(s)](store, s)))

    def load_csv(self, table: str, path: str, force: bool = False, key: str | None = None, quoted: bool = False) -> tuple[int, int]:
        """Creates the table from a file; gives the rows loaded and the rows left out."""
        counts = (0, 0)

        def change(store: Store) -> int:
            if table in store.open_txn:
                raise StorageError(f"table {table} exists")
            nonlocal counts
            columns, rows, written = csv.read_csv(self.spark, path, force, key, quoted)
            store.create(table, Table(columns, key), rows)
            try:
                counts = written()
            except csv.CsvError:
                del store.open_txn[table]  # an open transaction goes on without it
                raise
            return counts[0]

        self._changing(change)
        return counts

    def import_table(self, name: str, df: DataFrame, key: str | None = None) -> int:
        """Creates the table from a DataFrame whose types the dialect has."""
        columns = [(f.name, types.kind_of(f.dataType)) for f in df.schema.fields]

        def change(store: Store) -> int:
            store.create(name, Table(columns, key), df)
            if key is not None and store.read(name).groupBy(f"`{key}`").count().filter("count > 1").limit(1).collect():
                raise StorageError("duplicate key")
            return 0

        return self._changing(change)

    def export(self, query: str, path: str) -> None:
        s = parse(query)
        if not isinstance(s, Select):
            raise DialectError("only a SELECT can be exported")
        csv.write_csv(Planner(self._table).select(s), path)

    def begin(self) -> None:
        self._stored().begin()

    def commit(self) -> None:
        self._stored().commit()

    def rollback(self) -> None:
        self._stored().rollback()

    def close(self) -> None:
        """An open transaction is undone."""
        if self.store is not None and self.store.open_txn is not None:
            self.store.rollback()

    def vacuum(self, retain_hours: float = RETENTION / 3600) -> int:
        """Removes files that changes have replaced, if older; gives their number."""
        return self._stored().vacuum(retain_hours * 3600)

    def physical_plan(self, select: str) -> str:
        """What Spark will run for a SELECT, as EXPLAIN gives the logical steps."""
        df = Planner(self._table).select(parse(select))
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def info(self) -> str:
        if self.store is None:
            return "read-only"
        return "transaction" if self.store.open_txn is not None else "auto-commit"

    def catalog(self) -> DataFrame:
        rows = [(n, c, k, c == t.key, c in t.indexes or c == t.key) for n, t in sorted(self.store.now.items()) for c, k in t.columns] if self.store else []
        rows += [(n, f.name, types.kind_of(f.dataType), False, False) for n, d in sorted(self.views.items()) for f in d.schema.fields]
        return self.spark.createDataFrame(rows, "table string, column string, type string, primary_key boolean, indexed boolean")
