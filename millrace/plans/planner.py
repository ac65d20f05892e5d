"""SELECT to a DataFrame: scan, joins, filter, grouping, having, order, projection, distinct, limit.

Everything is declared; Catalyst prunes, pushes down, picks join strategies and plans ORDER BY with LIMIT as a top-k.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.dialect.nodes import Agg, Col, Lit, Select, Star
from millrace.functions.aggregates import aggregate
from millrace.plans.binder import AnalysisError, Binder, Bound, Scope, Slot, aggregates_in, guarded


class Planner:
    """table: gives the DataFrame of a name, or None."""

    def __init__(self, table: Callable[[str], DataFrame | None]):
        self.table = table
        self.made = 0

    def _scan(self, name: str) -> tuple[DataFrame, list[Slot]]:
        df = self.table(name)
        if df is None:
            raise AnalysisError(f"no table {name}")
        slots = []
        for f in df.schema.fields:
            self.made += 1
            slots.append(Slot(name, f.name, f"c{self.made}", f.dataType))
        return df.toDF(*(s.own for s in slots)), slots

    def _joined(self, s: Select) -> tuple[DataFrame, list[Slot]]:
        df, slots = self._scan(s.table)
        for j in s.joins:
            other, more = self._scan(j.table)
            left, right = Scope(slots), Scope(more)
            try:
                a, b = left.find(j.left), right.find(j.right)
            except AnalysisError:
                a, b = left.find(j.right), right.find(j.left)  # written the other way round
            same = Binder._comparable(Bound(a.column, a.stored), Bound(b.column, b.stored))
            df = df.join(other, same[0] == same[1] if same else F.lit(False), "inner")
            slots = slots + more
        return df, slots

    def select(self, s: Select) -> DataFrame:
        df, slots = self._joined(s)
        scope = Scope(slots)
        if s.where is not None:
            df = df.filter(Binder(scope).condition(s.where))
        found = aggregates_in(*s.items, s.having, *(e for e, _ in s.order))
        if s.group or found:
            df, scope, binder = self._grouped(df, scope, s, found)
        else:
            binder = Binder(scope)
        if s.having is not None:
            df = df.filter(binder.condition(s.having))
        items: list[tuple[str, Bound, object]] = []
        bare = Counter(x.name for x in scope.slots)
        for e in s.items:
            if isinstance(e, Star):
                joined = bool(s.joins)
                items += [(f"{x.table}.{x.name}" if joined and x.table else x.name, Bound(x.column, x.stored), Col(x.name, x.table)) for x in scope.slots if not x.own.startswith("a")]
            else:
                name = str(e) if not isinstance(e, Col) or bare[e.name] > 1 else e.name
                items.append((name, binder.expression(e), e))
        guards = [g for _, b, _ in items for g in b.guards]
        if guards:  # a row without a value for an item is dropped, before order and limit
            df = df.filter(guarded(F.lit(True), guards))
        projected = [b.column.alias(f"o{i}") for i, (_, b, _) in enumerate(items)]
        if not s.distinct:
            keys = [(binder.expression(e).column, up) for e, up in s.order if not isinstance(e, Lit)]
            if keys:
                df = df.orderBy(*(c.asc() if up else c.desc() for c, up in keys))
            df = df.select(*projected)
        else:
            df = df.select(*projected).distinct()
            if s.order:  # keys that are not put out cannot order distinct rows
                place = {self._key(binder, e): f"o{i}" for i, (_, _, e) in reversed(list(enumerate(items)))}
                keys = [(place[k], up) for e, up in s.order if not isinstance(e, Lit) and (k := self._key(binder, e)) in place]
                rest = [f"o{i}" for i in range(len(items)) if f"o{i}" not in {k for k, _ in keys}]
                df = df.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in keys), *rest)
        if s.limit:
            df = df.limit(s.limit)
        return df.toDF(*(name for name, _, _ in items))

    @staticmethod
    def _key(binder: Binder, e) -> str:
        return binder.scope.find(e).own if isinstance(e, Col) else str(e)

    def _grouped(self, df: DataFrame, scope: Scope, s: Select, found: list[Agg]):
        keys = [scope.find(k) for k in s.group]
        slots, columns = [], []
        by: dict[Agg, Slot] = {}
        same: dict[tuple, Slot] = {}
        for i, a in enumerate(found):
            slot = scope.find(a.arg) if a.arg is not None else None
            key = (a.func, slot.own if slot and a.func != "count" else None)
            if key not in same:
                made = aggregate(a.func, slot.column if slot else None, slot.stored if slot else None)
                stored = T.LongType() if a.func == "count" else T.DoubleType() if a.func in ("sum", "avg") else slot.stored
                same[key] = Slot(None, str(a), f"a{i}", stored)
                columns.append(made.alias(f"a{i}"))
            by[a] = same[key]
        unique = list({k.own: k for k in keys}.values())
        if not keys:
            df = df.agg(*columns)
        elif columns:
            df = df.groupBy(*(k.column for k in unique)).agg(*columns)
        else:
            df = df.select(*(k.column for k in unique)).distinct()
        slots = [Slot(k.table, k.name, k.own, k.stored) for k in unique]
        scope = Scope(slots)
        return df, scope, Binder(scope, by)


