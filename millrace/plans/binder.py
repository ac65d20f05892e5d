"""Names and types are settled here, once, before Catalyst sees a plan.

An expression becomes a Column with guards: conditions that hold where its evaluation has a value.  Divisors must
differ from zero, and numbers read from texts must be numbers where they are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.dialect.nodes import Agg, Binary, Col, Compare, Lit, Logic, Unary


class AnalysisError(ValueError):
    """A statement whose names or types do not fit the catalog."""


@dataclass(frozen=True)
class Slot:
    """A column in scope: its table and name in the dialect, its name in the DataFrame, its type."""

    table: str | None
    name: str
    own: str
    stored: T.DataType

    @property
    def column(self) -> Column:
        return F.col(f"`{self.own}`")


class Scope:
    def __init__(self, slots: list[Slot]):
        self.slots = slots

    def find(self, ref: Col) -> Slot:
        found = [s for s in self.slots if s.name == ref.name and ref.table in (None, s.table)]
        if not found:
            raise AnalysisError(f"no column {ref}")
        if len(found) > 1:
            raise AnalysisError(f"{ref} is ambiguous: " + ", ".join(f"{s.table}.{s.name}" for s in found))
        return found[0]


@dataclass
class Bound:
    column: Column
    stored: T.DataType
    literal: Lit | None = None
    guards: list[Column] = field(default_factory=list)
    from_text: bool = False  # may be NaN for want of a number

    @property
    def numeric(self) -> bool:
        return isinstance(self.stored, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.stored, T.StringType)


def guarded(condition: Column, guards: list[Column]) -> Column:
    """An expression without a value makes the whole condition false."""
    return reduce(lambda a, b: a & b, guards, condition)


def _literal(e: Lit) -> Bound:
    if e.kind == "int":
        n = int(e.text)
        if -(1 << 63) <= n < 1 << 63:
            return Bound(F.lit(n).cast("bigint"), T.LongType(), e)
        return Bound(F.lit(float(n)), T.DoubleType(), e)
    if e.kind == "dec":
        return Bound(F.lit(float(e.text)), T.DoubleType(), e)
    return Bound(F.lit(e.text), T.StringType(), e)


def _number(b: Bound) -> Bound:
    """As double; texts that are no numbers become NaN."""
    if b.numeric:
        return Bound(b.column.cast("double"), T.DoubleType(), b.literal, b.guards, b.from_text)
    if b.text:
        return Bound(F.coalesce(b.column.try_cast("double"), F.lit(float("nan"))), T.DoubleType(), b.literal, b.guards, True)
    raise AnalysisError(f"no arithmetic on {b.stored.simpleString()}")


class Binder:
    """aggregates: after grouping, the slot of each aggregate."""

    def __init__(self, scope: Scope, aggregates: dict[Agg, Slot] | None = None):
        self.scope, self.aggregates = scope, aggregates

    def expression(self, e) -> Bound:
        if isinstance(e, Lit):
            return _literal(e)
        if isinstance(e, Col):
            slot = self.scope.find(e)
            return Bound(slot.column, slot.stored)
        if isinstance(e, Agg):
            if self.aggregates is None:
                raise AnalysisError(f"{e} is not allowed here")
            slot = self.aggregates[e]
            return Bound(slot.column, slot.stored)
        if isinstance(e, Unary):
            b = _number(self.expression(e.arg))
            return Bound(-b.column if e.op == "-" else b.column, b.stored, None, b.guards, b.from_text)
        if isinstance(e, Binary):
            a, b = _number(self.expression(e.left)), _number(self.expression(e.right))
            guards, nan = a.guards + b.guards, a.from_text or b.from_text
            if e.op == "/":
                return Bound(F.try_divide(a.column, b.column), T.DoubleType(), None, [*guards, b.column != 0], nan)
            return Bound({"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[e.op], T.DoubleType(), None, guards, nan)
        raise AnalysisError(f"no expression: {e!r}")

    def condition(self, e, total: bool = False) -> Column:
        """For a filter, null is as good as false (conditions know no NOT) and leaves comparisons to be pushed down; `total` makes it false."""
        column, guards = self._condition(e)
        column = guarded(column, guards)
        return F.coalesce(column, F.lit(False)) if total else column

    def _condition(self, e) -> tuple[Column, list[Column]]:
        if isinstance(e, Logic):
            (a, x), (b, y) = self._condition(e.left), self._condition(e.right)
            return (a & b if e.op == "AND" else a | b), x + y
        if not isinstance(e, Compare):
            raise AnalysisError(f"no condition: {e!r}")
        a, b = self.expression(e.left), self.expression(e.right)
        guards = a.guards + b.guards
        pair = self._comparable(a, b)
        if pair is None:
            return F.lit(False), guards
        if e.op != "!=":
            guards = guards + [~F.isnan(x.column) for x in (a, b) if x.from_text]
        left, right = pair
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[e.op], guards

    @staticmethod
    def _comparable(a: Bound, b: Bound) -> tuple[Column, Column] | None:
        """Both sides in one type: numbers by value, texts by bytes; a literal takes the other side's type; a number never equals a text."""
        if a.numeric and b.numeric or a.text and b.text:
            return a.column, b.column
        if a.numeric and b.text or a.text and b.numeric:
            number, text = (a, b) if a.numeric else (b, a)
            if text.literal is not None:
                try:
                    value = F.lit(int(text.literal.text)) if text.literal.text.lstrip("+-").isdigit() else F.lit(float(text.literal.text))
                except ValueError:
                    return None
                return (a.column, value) if a is number else (value, b.column)
            if number.literal is not None:
                value = F.lit(number.literal.text)
                return (value, b.column) if a is number else (a.column, value)
            return None
        return a.column, b.column


def aggregates_in(*nodes) -> list[Agg]:
    out: dict[Agg, None] = {}

    def walk(e) -> None:
        if isinstance(e, Agg):
            out[e] = None
        elif isinstance(e, Unary):
            walk(e.arg)
        elif isinstance(e, (Binary, Compare, Logic)):
            walk(e.left)
            walk(e.right)

    for n in nodes:
        walk(n)
    return list(out)
