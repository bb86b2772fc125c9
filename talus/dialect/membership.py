"""Joins by membership: x IN (e, f) between two relations becomes an equal join with the rows of e and f. Spark compares all pairs of rows otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .tokens import Token, parse, split

_ENDS = ("WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "FOR", "QUALIFY")
_SETS = ("UNION", "INTERSECT", "EXCEPT")
#: Words of a FROM clause that keep it as it is: its joins aren't inner ones of plain relations.
_OTHER = ("LEFT", "RIGHT", "FULL", "OUTER", "SEMI", "ANTI", "NATURAL", "LATERAL", "TABLESAMPLE", "ORDINALITY", "PIVOT", "UNPIVOT", "ONLY")
_NOT_X = {"NOT", "OR", "IS", "IN", "LIKE", "ILIKE", "SIMILAR", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE", "END", "ANY", "ALL", "SOME"}
_CONSTANTS = {"TRUE", "FALSE", "NULL", "AS", "INTERVAL", "DATE", "TIMESTAMP"}
_OPERATORS = {"+", "-", "*", "/", "%", "||"}
_VOLATILE = {"random", "rand", "randn", "uuid", "gen_random_uuid", "nextval"}


@dataclass
class _Relation:
    alias: str
    columns: list[str] | None
    start: int
    end: int
    #: Of a plain relation, whose rows may be taken several times.
    name: str = ""


def equal_joins(tokens: list[Token], columns: Callable[[str], list[str] | None], ctes: dict[str, list[str] | None] | None = None) -> list[Token]:
    """A token tree with such joins as equal ones; columns gives those of a known relation, in order."""
    ctes = dict(ctes or {})
    for k in range(len(tokens) - 1):  # names of WITH hide tables
        body = tokens[k + 1]
        if tokens[k].word("AS") and body.kind == "(" and body.inside and body.inside[0].word("SELECT", "WITH", "VALUES") and k:
            listed = tokens[k - 1] if tokens[k - 1].kind == "(" and k > 1 else None
            ctes[(tokens[k - 2] if listed else tokens[k - 1]).text.lower()] = [t.text.lower().strip('"') for t in listed.inside if t.kind in ("word", "quoted")] if listed else None
    known = lambda name: ctes[name] if name in ctes else columns(name)
    tokens = [Token(t.kind, t.text, equal_joins(t.inside, columns, ctes)) if t.kind in "([" else t for t in tokens]
    out: list[Token] = []
    part: list[Token] = []
    for t in tokens:
        if t.word(*_SETS):
            out += [*_core(part, known), t]
            part = []
        else:
            part.append(t)
    return out + _core(part, known)


def _core(tokens: list[Token], known: Callable[[str], list[str] | None]) -> list[Token]:
    """One SELECT, without set operations."""
    n = 0
    while (found := _rewritten(tokens, known, n)) is not None:
        tokens, n = found, n + 1
    return tokens


def _rewritten(tokens: list[Token], known: Callable[[str], list[str] | None], n: int) -> list[Token] | None:
    at = next((k for k, t in enumerate(tokens) if t.word("SELECT")), -1)
    start = next((k for k in range(max(at, 0) + 1, len(tokens)) if tokens[k].word("FROM") and not tokens[k - 1].word("DISTINCT")), -1)
    if at < 0 or start < 0:
        return None
    end = next((k for k in range(start, len(tokens)) if tokens[k].word(*_ENDS)), len(tokens))
    if any(t.word(*_OTHER) for t in tokens[start:end]):
        return None
    relations, spans = _from(tokens, start + 1, end, known)
    if end < len(tokens) and tokens[end].word("WHERE"):
        spans.append((end + 1, next((k for k in range(end + 1, len(tokens)) if tokens[k].word(*_ENDS)), len(tokens))))
    for a, b in spans:
        if any(t.word("OR", "BETWEEN", "CASE") for t in tokens[a:b]):
            continue
        k = a
        for conjunct in _conjuncts(tokens[a:b]):
            lo, k = k, k + len(conjunct) + 1
            x, values = _membership(conjunct)
            mine, other = _used(values, relations) if values else None, _used(x, relations) if x else None
            if not mine or not other or len(mine) != 1 or mine & other:
                continue
            r = relations[next(iter(mine))]
            items = _listed(tokens[at + 1 : start], relations, any(t.word("USING") for t in tokens[start:end]))
            if not r.name or items is None:
                continue
            name, seen, elements = f"__in{n}", [], []
            for e in split(values):  # of equal elements the first counts
                elements += [Token("mark", ",")] * bool(seen) + ([*_words("CASE", "WHEN"), Token("(", "", e), *_words("IN"), Token("(", "", seen[:]), *_words("THEN", "NULL", "ELSE"), Token("(", "", e), *_words("END")] if seen else e)
                seen += [Token("mark", ",")] * bool(seen) + e
            inner = [*parse("SELECT *, explode()"), *_words("AS", name, "FROM", r.name, "AS", r.alias)]
            inner[4].inside = [Token("word", "ARRAY"), Token("[", "", elements)]
            taken = [Token("(", "", inner), *_words("AS", r.alias)]
            equal = [Token("(", "", x), Token("op", "="), *_words(name)]
            # from the right, so that places stay
            out = [*tokens[:lo], *equal, *tokens[lo + len(conjunct) :]]
            out = [*out[: r.start], *taken, *out[r.end :]]
            return [*out[: at + 1], *items, *out[start:]]
    return None


def _words(*names: str) -> list[Token]:
    return [Token("word", x) for x in names]


def _from(tokens: list[Token], i: int, end: int, known: Callable[[str], list[str] | None]) -> tuple[list[_Relation], list[tuple[int, int]]]:
    """The relations of a FROM clause, and the spans of its conditions."""
    relations, spans = [], []
    while i < end:
        t = tokens[i]
        if t.word("JOIN", "INNER", "CROSS") or t.op(","):
            i += 1
        elif t.word("ON"):
            stop = next((k for k in range(i, end) if tokens[k].word("JOIN", "INNER", "CROSS") or tokens[k].op(",")), end)
            spans.append((i + 1, stop))
            i = stop
        elif t.word("USING"):
            i += 2
        else:
            stop = next((k for k in range(i, end) if tokens[k].word("JOIN", "INNER", "CROSS", "ON", "USING") or tokens[k].op(",")), end)
            body = [x for x in tokens[i:stop] if not x.word("AS")]
            plain = body[0].kind == "word" and len(body) <= 2 and all(x.kind == "word" for x in body)
            alias = next((x.text for x in reversed(body) if x.kind in ("word", "quoted")), "")
            relations.append(_Relation(alias, known(body[0].text.lower()) if plain else None, i, stop, body[0].text if plain and known(body[0].text.lower()) else ""))
            i = stop
    return relations, spans


def _conjuncts(tokens: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.word("AND"):
            out.append([])
        else:
            out[-1].append(t)
    return out


def _membership(tokens: list[Token]) -> tuple[list[Token], list[Token]]:
    """x and the list of x IN (list); empty if it is something else."""
    while len(tokens) == 1 and tokens[0].kind == "(":
        tokens = tokens[0].inside
    if len(tokens) < 3 or tokens[-1].kind != "(" or not tokens[-2].word("IN"):
        return [], []
    x, values = tokens[:-2], tokens[-1].inside
    simple = not any(t.word(*_NOT_X) or t.kind == "op" and t.text not in _OPERATORS | {"::"} for t in x)
    return (x, values) if simple and values and not values[0].word("SELECT", "WITH", "VALUES", "TABLE") else ([], [])


def _used(tokens: list[Token], relations: list[_Relation]) -> set[int] | None:
    """The relations whose columns an expression reads; None if that isn't sure."""
    out: set[int] = set()
    k = 0
    while k < len(tokens):
        t, after = tokens[k], tokens[k + 1] if k + 1 < len(tokens) else None
        if t.kind in "([":
            if t.inside and t.inside[0].word("SELECT", "WITH", "VALUES", "TABLE") or (found := _used(t.inside, relations)) is None:
                return None
            out |= found
        elif t.op("::") or t.word("AS"):  # a type's name follows
            k += 2 if k + 2 < len(tokens) and tokens[k + 2].word("PRECISION", "VARYING") else 1
        elif t.kind in ("word", "quoted") and after is not None and after.op("."):
            owner = [j for j, r in enumerate(relations) if r.alias.lower() == t.text.lower()]
            if len(owner) != 1:
                return None
            out.add(owner[0])
            k += 2
        elif t.kind == "word" and after is not None and after.kind == "(":
            if t.text.lower() in _VOLATILE:
                return None
        elif t.kind in ("word", "quoted"):
            if t.text.upper() not in _CONSTANTS:
                owner = [j for j, r in enumerate(relations) if r.columns and t.text.lower().strip('"') in r.columns]
                if len(owner) != 1:
                    return None
                out.add(owner[0])
        elif t.kind not in ("number", "string") and not t.op(*_OPERATORS, ","):
            return None
        k += 1
    return out


def _listed(items: list[Token], relations: list[_Relation], using: bool) -> list[Token] | None:
    """A select list in which stars are columns by name, so that what is added to a relation doesn't come out; None if a star's columns aren't known."""
    out: list[Token] = []
    for k, part in enumerate(split(items)):
        out += [Token("mark", ",")] * (k > 0)
        if not part or not part[-1].op("*"):
            out += part
            continue
        head, mine = part[:-1], relations
        if len(head) >= 2 and head[-1].op("."):
            mine, head = [r for r in relations if r.alias.lower() == head[-2].text.lower()], head[:-2]
        if using or not mine or any(r.columns is None for r in mine) or any(not t.word("ALL", "DISTINCT") for t in head):
            return None
        out += head
        for j, (r, c) in enumerate((r, c) for r in mine for c in r.columns):
            out += [Token("mark", ",")] * (j > 0) + [Token("word", r.alias), Token("mark", "."), Token("quoted", f'"{c}"')]
    return out
