"""A prompt: python -m millrace FOLDER"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from millrace.functions.formats import shown
from millrace.session import Session


def show(df, limit: int = 1000) -> str:
    found = df.limit(limit + 1).collect()
    rows = [list(df.columns), *([shown(v) for v in r] for r in found[:limit])]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    text = "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows)
    return text if len(found) <= limit else f"{text}\n(the first {limit} rows; EXPORT gives all)"


def main() -> None:
    session = Session(SparkSession.builder.getOrCreate(), sys.argv[1])
    try:
        while (line := input("> ").strip()).upper() not in ("QUIT", "EXIT"):
            if line.upper() == "CLEAR":
                print("\033[2J\033[H", end="")
            elif line:
                try:
                    print(show(session.sql(line)))
                except Exception as e:
                    print(f"error: {e}")
    except EOFError:
        pass
    finally:
        session.close()


if __name__ == "__main__":
    main()
