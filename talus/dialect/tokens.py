"""A tokenizer for PostgreSQL-flavoured SQL, and token trees of balanced brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)|(?P<string>[eE]?'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")
    |(?P<back>`[^`]*`)|(?P<number>\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<param>\$\d+|:[A-Za-z_]\w*(?<!:))|(?P<word>[A-Za-z_][\w$]*)
    |(?P<op>!~~\*|!~\*|!~~|->>|\#>>|<->|!~|~\*|~~|~=|\^@|->|\#>|\#-|@>|<@|&&|\?\||\?&|@@|\|\||::|:=|<=|>=|<>|!=|=>|\.\.|[-+*/%<>=~?^&|@\#!])|(?P<mark>[()\[\],;.:])""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")", "]"}


@dataclass
class Token:
    kind: str
    text: str
    #: Of a group, kind "(" or "[".
    inside: list[Token] = field(default_factory=list)

    def __repr__(self) -> str:
        return render([self])

    def word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.upper() in names

    def op(self, *names: str) -> bool:
        return self.kind in ("op", "mark") and self.text in names


class DialectError(ValueError):
    """SQL of a shape that the dialect doesn't know."""


def flat(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character at {at}: {sql[at : at + 20]!r}")
        at = m.end()
        kind = "dollar" if m["dollar"] else m.lastgroup
        if kind == "tag":
            kind = "dollar"
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0]))
    return out


def tree(tokens: list[Token]) -> list[Token]:
    """Brackets become groups."""
    stack: list[tuple[str, list[Token]]] = [("", [])]
    for t in tokens:
        if t.kind == "mark" and t.text in _OPEN:
            stack.append((t.text, []))
        elif t.kind == "mark" and t.text in _CLOSE:
            opened, inside = stack.pop()
            if not stack or _OPEN.get(opened) != t.text:
                raise DialectError(f"unbalanced {t.text}")
            stack[-1][1].append(Token(opened, "", inside))
        else:
            stack[-1][1].append(t)
    if len(stack) > 1:
        raise DialectError(f"unbalanced {stack[-1][0]}")
    return stack[0][1]


def parse(sql: str) -> list[Token]:
    return tree(flat(sql))


def split(tokens: list[Token], mark: str = ",") -> list[list[Token]]:
    """The parts between marks; none of an empty list."""
    if not tokens:
        return []
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.op(mark):
            out.append([])
        else:
            out[-1].append(t)
    return out


def literal(t: Token) -> str:
    """The text that a string or dollar-quoted token stands for."""
    if t.kind == "dollar":
        tag = t.text[: t.text.index("$", 1) + 1]
        return t.text[len(tag) : -len(tag)]
    if t.text[0] in "eE":
        body = t.text[2:-1].replace("''", "'")
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), body, flags=re.S)
    return t.text[1:-1].replace("''", "'")


def quote(text: str) -> str:
    """A string literal for Spark, where a backslash escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def raw(sql: str) -> Token:
    """Finished Spark SQL, one operand."""
    return Token("raw", sql)


def render(tokens: list[Token]) -> str:
    """Spark SQL of tokens."""
    out = []
    for t in tokens:
        if t.kind in _OPEN:
            out.append(t.kind + render(t.inside) + _OPEN[t.kind])
        elif t.kind in ("string", "dollar"):
            out.append(quote(literal(t)))
        elif t.kind == "quoted":
            out.append("`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            out.append(t.text)
    sql = ""
    for k, part in enumerate(out):
        tight = k == 0 or part in (",", ";", ".") or out[k - 1] == "." or part == "::" or out[k - 1] == "::" or (tokens[k].kind == "[") or (tokens[k].kind == "(" and tokens[k - 1].kind == "word" and tokens[k - 1].text.upper() not in _SPACED)
        sql += part if tight else " " + part
    return sql


_SPACED = {"IN", "AND", "OR", "NOT", "AS", "FROM", "WHERE", "ON", "SELECT", "VALUES", "EXISTS", "ANY", "ALL", "OVER", "BY", "JOIN", "UNION", "EXCEPT", "INTERSECT", "WITH", "THEN", "ELSE", "WHEN", "LATERAL", "GROUP", "USING", "LIMIT", "HAVING", "CASE", "BETWEEN", "LIKE", "SETS"}


def statements(sql: str) -> list[str]:
    """A script's statements; semicolons in strings and dollar quotes don't count."""
    out, start, at = [], 0, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"unexpected character at {at}: {sql[at : at + 20]!r}")
        if m[0] == ";":
            out.append(sql[start:at])
            start = m.end()
        at = m.end()
    return [s.strip() for s in [*out, sql[start:]] if s.strip()]
