"""Scripts with COPY blocks, as dumps have them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..dialect.tokens import statements

_COPY = re.compile(r"^COPY\s.+\sFROM\s+stdin", re.I | re.S)


def parts(text: str) -> Iterator[tuple[str, list[str] | None]]:
    """Statements in order; that of a COPY FROM stdin comes with its lines."""
    held: list[str] = []
    lines = iter(text.split("\n"))
    for line in lines:
        if not held and (not line.strip() or line.startswith(("--", "\\"))):
            continue
        held.append(line)
        joined = "\n".join(held)
        if not joined.rstrip().endswith(";"):
            continue
        if joined.count("'") % 2 or len(re.findall(r"\$[A-Za-z_]*\$", joined)) % 2:
            continue
        for sql in statements(joined):
            if _COPY.match(sql):
                data = []
                for row in lines:
                    if row == "\\.":
                        break
                    data.append(row)
                yield sql, data
            else:
                yield sql, None
        held = []
    if "".join(held).strip():
        yield from ((s, None) for s in statements("\n".join(held)))
