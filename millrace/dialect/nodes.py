"""Syntax tree of the dialect, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return self.name if self.table is None else f"{self.table}.{self.name}"


@dataclass(frozen=True)
class Lit:
    """kind: int, dec or str; text as written, without quotes."""

    kind: str
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object

    def __str__(self) -> str:
        return f"({self.op}{self.arg})"


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Agg:
    """func in lower case; arg None for COUNT(*)."""

    func: str
    arg: Col | None

    def __str__(self) -> str:
        return f"{self.func.capitalize()}({'*' if self.arg is None else self.arg})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Join:
    table: str
    left: Col
    right: Col


@dataclass(frozen=True)
class Select:
    items: tuple
    table: str
    joins: tuple[Join, ...] = ()
    where: object | None = None
    group: tuple[Col, ...] = ()
    having: object | None = None
    order: tuple[tuple[object, bool], ...] = ()
    distinct: bool = False
    limit: int = 0


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]
    key: str | None = None
    indexes: tuple[str, ...] = ()


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Lit, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Lit], ...]
    where: object | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None = None


@dataclass(frozen=True)
class Explain:
    statement: object = field()
