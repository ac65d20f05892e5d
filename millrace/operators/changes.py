"""CREATE, INSERT, UPDATE and DELETE on immutable files: those with changed rows are written anew, the others stay; inserts add one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.dialect.nodes import CreateIndex, CreateTable, Delete, Insert, Update
from millrace.functions import types
from millrace.plans.binder import Binder, Scope, Slot
from millrace.sources.storage import StorageError, Store, Table


def _table(store: Store, name: str) -> Table:
    if name not in store.open_txn:
        raise StorageError(f"no table {name}")
    return store.open_txn[name]


def _matching(df: DataFrame, name: str, where):
    """The condition of UPDATE and DELETE: true or false on every row."""
    if where is None:
        return F.lit(True)
    return Binder(Scope([Slot(name, f.name, f.name, f.dataType) for f in df.schema.fields])).condition(where, total=True)


def create_table(store: Store, s: CreateTable) -> int:
    store.create(s.name, Table(list(s.columns), s.key, list(dict.fromkeys(s.indexes))))
    return 0


def create_index(store: Store, s: CreateIndex) -> int:
    """Notes the index and writes the present rows in ranges of the column, one a file; from now on the table's files are ordered by it and
    carry a bloom filter of it."""
    t = _table(store, s.table)
    t.kind(s.column)
    if s.column in t.indexes or s.column == t.key:
        raise StorageError(f"{s.table}({s.column}) has an index")
    t.indexes = [*t.indexes, s.column]
    if t.files:
        store.replace(s.table, store.read(s.table).repartitionByRange(F.col(f"`{s.column}`")))
    return 0


def insert(store: Store, s: Insert) -> int:
    t = _table(store, s.table)
    names = list(s.columns) or [n for n, _ in t.columns]
    if len(names) != len(s.values):
        raise StorageError(f"{len(names)} columns and {len(s.values)} values")
    given = dict(zip(names, s.values, strict=True))
    if len(given) < len(names):
        raise StorageError("a column is given twice")
    for n in names:
        t.kind(n)
    if missing := [n for n, _ in t.columns if n not in given]:
        raise StorageError(f"missing value for {missing[0]}")
    try:
        row = [types.value(given[n].text, k) for n, k in t.columns]
    except (ValueError, OverflowError) as e:
        raise StorageError(str(e)) from e
    df = store.spark.createDataFrame([row], t.schema)
    if t.key is not None:
        value = row[[n for n, _ in t.columns].index(t.key)]
        if store.read(s.table).filter(F.col(f"`{t.key}`") == F.lit(value)).limit(1).collect():
            raise StorageError(f"duplicate key {value}")
    store.append(s.table, df.coalesce(1))
    return 1


def update(store: Store, s: Update) -> int:
    t = _table(store, s.table)
    df = store.read(s.table)
    match = _matching(df, s.table, s.where)
    sets = {}
    for c, lit in s.sets:
        k = t.kind(c)
        try:
            sets[c] = F.lit(types.value(lit.text, k)).cast(types.KINDS[k].stored)
        except (ValueError, OverflowError) as e:
            raise StorageError(str(e)) from e
    files, n = store.holding(s.table, match)
    if not n:
        return 0
    rows = store.files_of(t, files)
    new = rows.select(*(F.when(match, sets[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in df.columns))
    if t.key in sets:
        own = F.col(f"`{t.key}`")
        others = store.files_of(t, [f for f in t.files if f not in set(files)])
        if n > 1 or new.select(own).unionByName(others.select(own)).groupBy(own).count().filter("count > 1").limit(1).collect():
            raise StorageError("duplicate key")
    store.replace(s.table, new, files)
    return n


def delete(store: Store, s: Delete) -> int:
    t = _table(store, s.table)
    match = _matching(store.read(s.table), s.table, s.where)
    files, n = store.holding(s.table, match)
    if n:
        store.replace(s.table, store.files_of(t, files).filter(~match), files)
    return n


CHANGES = {CreateTable: create_table, CreateIndex: create_index, Insert: insert, Update: update, Delete: delete}
