"""Function libraries. Each function is a macro: its arguments' Spark SQL in, Spark SQL out, so that all of it stays in Catalyst's hands.

Functions that Spark has under the same name and with the same meaning need no entry. `call` applies one to DataFrame columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MACROS: dict[str, Callable[..., str]] = {}


def macro(*names: str):
    def keep(f: Callable[..., str]) -> Callable[..., str]:
        for n in names:
            MACROS[n] = f
        return f

    return keep


def text_of(arg: str) -> str:
    """The text of a constant argument."""
    from ..dialect.tokens import DialectError

    if len(arg) < 2 or arg[0] != "'" or arg[-1] != "'":
        raise DialectError(f"a constant string is needed here, not {arg}")
    out, i = [], 1
    while i < len(arg) - 1:
        if arg[i] == "\\":
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(arg[i + 1], arg[i + 1]))
            i += 2
        else:
            out.append(arg[i])
            i += 1
    return "".join(out)


def call(name: str, *args: str | Column) -> Column:
    """A function of the libraries on columns: strings are Spark SQL, e.g. call("age", "a.ts", "b.ts"), call("to_char", "ts", "'YYYY'")."""
    load()
    return F.expr(MACROS[name.lower()](*args))


def load() -> dict[str, Callable[..., str]]:
    from . import arrays, datetimes, jsons, maths, networks, ranges, shapes, strings, system, texts, xml  # noqa: F401

    return MACROS
