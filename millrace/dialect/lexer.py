"""Tokens: words, quoted names ("x" or $x$), numbers, 'strings' and marks."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A statement that cannot be read."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name, int, dec, str, mark, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""\s*(?:(?P<word>[A-Za-z_]\w*)|"(?P<name>[^"]*)"|\$(?P<dollar>[^$]*)\$|(?P<dec>\d+\.\d*|\.\d+)|(?P<int>\d+)|'(?P<str>[^']*)'|(?P<mark><=|>=|!=|<>|[=<>+\-*/(),.;]))""", re.ASCII)  # fmt: skip


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise DialectError(f"unexpected character at {at}: {text[at:at + 20]!r}")
        kind = m.lastgroup or "mark"
        out.append(Token("name" if kind == "dollar" else kind, m.group(kind), m.start(kind)))
        at = m.end()
    return [*out, Token("end", "", end)]
