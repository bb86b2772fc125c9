"""PostgreSQL-flavoured queries in Spark's SQL: only what Spark's grammar lacks or means differently is changed. What isn't understood raises DialectError."""

from __future__ import annotations

import re

from .. import functions
from . import patterns
from .tokens import DialectError, Token, literal, parse, quote, raw, render, split

#: Type names and Spark's.
TYPES = {
    "text": "STRING", "varchar": "STRING", "char": "STRING", "bpchar": "STRING", "name": "STRING", "character": "STRING", "json": "STRING", "jsonb": "STRING", "uuid": "STRING", "xml": "STRING", "inet": "STRING", "cidr": "STRING",
    "macaddr": "STRING", "tsvector": "STRING", "tsquery": "STRING", "point": "STRING", "line": "STRING", "lseg": "STRING", "box": "STRING", "path": "STRING", "polygon": "STRING", "circle": "STRING", "time": "STRING",
    "timetz": "STRING", "int4range": "STRING", "int8range": "STRING", "numrange": "STRING", "tsrange": "STRING", "daterange": "STRING", "int2": "SMALLINT", "smallint": "SMALLINT", "int4": "INT", "int": "INT", "integer": "INT",
    "int8": "BIGINT", "bigint": "BIGINT", "serial": "BIGINT", "bigserial": "BIGINT", "oid": "BIGINT", "regclass": "BIGINT", "real": "FLOAT", "float4": "FLOAT", "float8": "DOUBLE", "float": "DOUBLE", "double": "DOUBLE", "bool": "BOOLEAN",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP_NTZ", "bytea": "BINARY", "money": "DECIMAL(19, 2)", "numeric": "DECIMAL(38, 18)", "decimal": "DECIMAL(38, 18)", "string": "STRING", "binary": "BINARY",
    "variant": "VARIANT", "timestamp_ntz": "TIMESTAMP_NTZ",
}
_JSON_OPS, _COMPARE = ("->", "->>", "#>", "#>>"), ("=", "<>", "!=", "<", "<=", ">", ">=")
_BOUNDS = {
    "AND", "OR", "NOT", "WHERE", "ON", "HAVING", "SELECT", "WHEN", "THEN", "ELSE", "CASE", "BY", "FROM", "AS", "DISTINCT", "ALL", "RETURNING", "SET", "VALUES", "USING", "FILTER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "IS", "IN", "LIKE",
    "ILIKE", "BETWEEN", "ASC", "DESC", "NULLS", "END", "GROUP", "ORDER", "WINDOW", "OFFSET", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS",
}
_NOT_NAMES = _BOUNDS | {"EXISTS", "ANY", "SOME", "OVER", "WITHIN", "PARTITION", "ROWS", "RANGE", "WITH", "LATERAL", "INTERVAL", "ARRAY", "SETS", "ROLLUP", "CUBE", "VALUES", "TABLESAMPLE"}
_HYPOTHETICAL = {"rank", "dense_rank", "percent_rank", "cume_dist"}


def rewrite(sql: str) -> str:
    return render(level(parse(sql.strip().rstrip(";"))))


def expression(sql: str) -> str:
    return rewrite(sql)


def level(tokens: list[Token]) -> list[Token]:
    """The tokens between two brackets, or of a whole statement."""
    tokens = [Token(t.kind, t.text, _limited(level(t.inside)) if t.kind == "(" else level(t.inside)) if t.kind in "([" else t for t in tokens]
    tokens = _clauses(tokens)
    tokens = _distinct_on(tokens)
    tokens = _order_nulls(tokens)
    tokens = _primaries(tokens)
    tokens = _arrows(tokens)
    return _operators(tokens)


def is_query(tokens: list[Token]) -> bool:
    return bool(tokens) and tokens[0].word("SELECT", "WITH", "VALUES", "TABLE")


def _clauses(tokens: list[Token]) -> list[Token]:
    out, i = [], 0
    while i < len(tokens):
        t, rest = tokens[i], tokens[i + 1 :]
        if t.word("FETCH") and rest and rest[0].word("FIRST", "NEXT"):  # FETCH FIRST n ROWS ONLY
            n = rest[1] if rest[1].kind == "number" else None
            end = next(k for k in range(i, len(tokens)) if tokens[k].word("ONLY"))
            out += [Token("word", "LIMIT"), n or Token("number", "1")]
            i = end + 1
        elif t.word("ROW", "ROWS") and len(out) >= 2 and out[-2].word("OFFSET"):
            i += 1
        elif t.word("FOR") and rest and rest[0].word("UPDATE", "SHARE") and not any(x.kind == "(" for x in rest[:1]):
            i = len(tokens)
        elif t.word("TABLESAMPLE") and rest and rest[0].word("BERNOULLI", "SYSTEM"):
            share = render(rest[1].inside)
            out.append(raw(f"TABLESAMPLE ({share} PERCENT)" if 0 < float(share) < 100 else ""))
            i += 3
            if i < len(tokens) and tokens[i].word("REPEATABLE"):
                out[-1] = raw(f"{out[-1].text} REPEATABLE ({render(tokens[i + 1].inside)})")
                i += 2
        else:
            out.append(t)
            i += 1
    offset, limit = _find(out, "OFFSET"), _find(out, "LIMIT")
    if 0 <= offset < limit:  # Spark has LIMIT first
        out = [*out[:offset], *out[limit:], *out[offset:limit]]
    return out


def _find(tokens: list[Token], *words: str, start: int = 0) -> int:
    return next((k for k in range(start, len(tokens)) if tokens[k].word(*words)), -1)


def _distinct_on(tokens: list[Token]) -> list[Token]:
    at = next((k for k in range(len(tokens) - 3) if tokens[k].word("SELECT") and tokens[k + 1].word("DISTINCT") and tokens[k + 2].word("ON") and tokens[k + 3].kind == "("), -1)
    if at < 0:
        return tokens
    if _find(tokens, "UNION", "INTERSECT", "EXCEPT") >= 0:
        raise DialectError("DISTINCT ON in a set operation needs brackets")
    keys, body = tokens[at + 3].inside, tokens[at + 4 :]
    start = _find(body, "FROM")
    order = next((k for k in range(len(body) - 1) if body[k].word("ORDER") and body[k + 1].word("BY")), -1)
    limit = _find(body, "LIMIT", "OFFSET")
    stop = min(x for x in (order, limit, len(body)) if x >= 0)
    by = body[order + 2 : limit if limit > order else len(body)] if order >= 0 else keys
    word = lambda *w: [Token("word", x) for x in w]
    over = _order_nulls([*word("PARTITION", "BY"), *keys, *word("ORDER", "BY"), *by])
    inner = [*word("SELECT"), *body[:start], Token("mark", ","), *word("row_number"), Token("(", ""), *word("OVER"), Token("(", "", over), *word("AS", "__rn"), *body[start:stop]]
    outputs = {part[-1].text.lower() for part in split(body[:start]) if part}
    plain = lambda part: [x for x in part if not x.word("ASC", "DESC", "NULLS", "FIRST", "LAST") and x.kind != "raw"]
    kept = []  # of the order, what the result still has
    for part in split(by) if order >= 0 else []:
        if len(plain(part)) != 1 or plain(part)[0].text.lower() not in outputs:
            break
        kept += [Token("mark", ",")] * bool(kept) + part
    outer = [*tokens[:at], raw("SELECT * EXCEPT (__rn) FROM"), Token("(", "", level(inner)), raw("WHERE __rn = 1")]
    return [*outer, *([*word("ORDER", "BY"), *kept] if kept else []), *(body[limit:] if limit >= 0 else [])]


def _limited(tokens: list[Token]) -> list[Token]:
    """A subquery with ORDER BY and LIMIT gets its sort keys as columns of its own, which the query around it leaves out. Spark sorts the rows of
    each outer row in a correlated subquery only if its sort stands right below the limit, which it doesn't if a key is no column of the result."""
    at, limit = _find(tokens, "SELECT"), _find(tokens, "LIMIT", "OFFSET")
    order = next((k for k in range(len(tokens) - 1) if tokens[k].word("ORDER") and tokens[k + 1].word("BY")), -1)
    start = next((k for k in range(1, len(tokens)) if tokens[k].word("FROM") and not tokens[k - 1].word("DISTINCT")), -1)
    if not 0 <= at < start < order < limit or tokens[at + 1].word("DISTINCT") or _find(tokens, "UNION", "INTERSECT", "EXCEPT") >= 0:
        return tokens
    items = split(tokens[at + 1 : start])
    aliases = {x[-1].text.lower() for x in items if len(x) > 1 and x[-1].kind in ("word", "quoted") and not x[-2].op(".")}
    keys, by = [], []
    for part in split(tokens[order + 2 : limit]):
        end = next((k for k, t in enumerate(part) if k and (t.word("ASC", "DESC", "NULLS") or t.kind == "raw" and t.text.startswith("NULLS "))), len(part))
        key = part[:end]
        if len(key) == 1 and (key[0].kind == "number" or key[0].word("ALL") or key[0].text.lower() in aliases):  # a column of the result
            by.append(part)
        else:
            by.append([raw(f"__sort{len(keys)}"), *part[end:]])
            keys.append(key)
    if not keys:
        return tokens
    comma, names = Token("mark", ","), [f"__sort{k}" for k in range(len(keys))]
    columns = [t for name, key in zip(names, keys, strict=True) for t in [comma, *key, Token("word", "AS"), Token("word", name)]]
    inner = [*tokens[:start], *columns, *tokens[start : order + 2], *[t for k, part in enumerate(by) for t in [comma] * (k > 0) + part], *tokens[limit:]]
    return [Token("word", "SELECT"), raw(f"* EXCEPT ({', '.join(names)}) FROM"), Token("(", "", inner)]


def _order_nulls(tokens: list[Token]) -> list[Token]:
    """Nulls are larger than any value: last in ascending order, first in descending."""
    out, i = [], 0
    while i < len(tokens):
        out.append(tokens[i])
        if tokens[i].word("BY") and i and tokens[i - 1].word("ORDER"):
            end = i + 1
            while end < len(tokens) and not tokens[end].word("LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "FETCH", "WINDOW") and not tokens[end].op(";"):
                end += 1
            for k, part in enumerate(split(tokens[i + 1 : end])):
                out += [Token("mark", ",")] * (k > 0) + part
                if part and not any(x.word("NULLS") or x.kind == "raw" and x.text.startswith("NULLS ") for x in part) and not part[0].word("ALL"):
                    out.append(raw("NULLS FIRST" if any(x.word("DESC") for x in part) else "NULLS LAST"))
            i = end
        else:
            i += 1
    return out


def type_of(tokens: list[Token]) -> tuple[str, int]:
    """Spark's name of the type that tokens begin with, and how many of them it takes."""
    if not tokens or tokens[0].kind not in ("word", "quoted"):
        raise DialectError(f"a type is needed at {render(tokens[:3])}")
    name, n = tokens[0].text.lower(), 1
    if name == "double" and n < len(tokens) and tokens[n].word("PRECISION") or name == "character" and n < len(tokens) and tokens[n].word("VARYING"):
        n += 1
    kind = TYPES.get(name, name.upper() if name in ("interval",) else None)
    if kind is None:
        raise DialectError(f"unknown type {name}")
    if n < len(tokens) and tokens[n].kind == "(":
        if name in ("numeric", "decimal"):
            kind = f"DECIMAL({render(tokens[n].inside)})"
        n += 1
    if name in ("timestamp", "time") and n + 2 < len(tokens) and tokens[n].word("WITH", "WITHOUT") and tokens[n + 1].word("TIME"):
        n += 3
    while n < len(tokens) and tokens[n].kind == "[":
        kind, n = f"ARRAY<{kind}>", n + 1
    return kind, n


def _cast(x: list[Token], kind: str) -> Token:
    if len(x) == 1 and x[0].kind in ("string", "dollar"):
        text = literal(x[0])
        if kind == "INTERVAL":
            return raw(patterns.make_interval(text))
        if kind.startswith("ARRAY<") and text.strip()[:1] == "{":
            items = [s.strip().strip('"') for s in text.strip()[1:-1].split(",")] if text.strip()[1:-1].strip() else []
            return raw(f"CAST(array({', '.join('NULL' if s == 'NULL' else quote(s) for s in items)}) AS {kind})")
    if kind == "INTERVAL":
        raise DialectError("an interval needs a constant text")
    return raw(f"CAST({render(x)} AS {kind})")


def _primaries(tokens: list[Token]) -> list[Token]:
    """Function calls, constructors, casts and subscripts become single operands where they differ from Spark's."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
        if t.word("ARRAY") and after and after.kind == "[":
            out.append(raw(_array(after)))
            i += 2
        elif t.word("ARRAY") and after and after.kind == "(" and is_query(after.inside):
            raise DialectError("ARRAY(query) is not known; aggregate with array_agg")
        elif t.word("INTERVAL") and after and after.kind in ("string", "dollar"):
            unit = tokens[i + 2] if i + 2 < len(tokens) else None
            alone = re.fullmatch(r"\s*[+-]?\d+\s*", literal(after))
            if alone and unit and unit.word("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "WEEK"):
                out.append(raw(patterns.make_interval(f"{literal(after)} {unit.text}")))
                i += 3
            else:
                out.append(raw(patterns.make_interval(literal(after))))
                i += 2
        elif t.word("TIMESTAMP", "TIMESTAMPTZ") and after and after.kind == "string":
            out.append(raw(f"CAST({quote(literal(after))} AS TIMESTAMP_NTZ)"))
            i += 2
        elif t.word("CURRENT_DATE", "CURRENT_TIMESTAMP", "LOCALTIMESTAMP") and not (after and after.kind == "("):
            out.append(raw(f"{t.text.lower() if not t.word('LOCALTIMESTAMP') else 'current_timestamp'}()"))
            i += 1
        elif t.kind == "word" and after and after.kind == "(" and t.text.upper() not in _NOT_NAMES and not (out and out[-1].op(".")):
            made, n = _call(t, after, tokens[i + 2 :])
            out += made
            i += 2 + n
        elif t.word("SELECT") and after and after.kind == "string" and not (i + 2 < len(tokens) and tokens[i + 2].op("::")):
            out += [t, raw(f"CAST({quote(literal(after))} AS STRING)")]  # else Spark takes it for a typed literal
            i += 2
        elif t.op("::"):
            kind, n = type_of(tokens[i + 1 :])
            x = _left(out)
            out.append(_cast(x, kind))
            i += 1 + n
        elif t.kind == "[":
            x = _left(out)
            out.append(_subscript(x, t))
            i += 1
        else:
            out.append(t)
            i += 1
    return out


def _array(group: Token) -> str:
    return "array(" + ", ".join(_array(p[0]) if len(p) == 1 and p[0].kind == "[" else render(p) for p in split(group.inside)) + ")"


def _subscript(x: list[Token], group: Token) -> Token:
    parts = split(group.inside, ":")
    if len(parts) == 2:
        low, high = (render(p) if p else None for p in parts)
        return raw(functions.load()["array_slice"](render(x), low or "1", high or f"size({render(x)})"))
    return raw(functions.load()["array_at"](render(x), render(group.inside)))


def _call(name: Token, group: Token, after: list[Token]) -> tuple[list[Token], int]:
    """A call's operand, and how many tokens after it belong to it."""
    macros, low, inside = functions.load(), name.text.lower(), group.inside
    args = split(inside)
    if low in ("cast", "try_cast"):
        at = max(k for k, t in enumerate(inside) if t.word("AS"))
        kind, _ = type_of(inside[at + 1 :])
        made = _cast(inside[:at], kind)
        return [raw(made.text.replace("CAST(", "TRY_CAST(", 1)) if low == "try_cast" else made], 0
    if low == "extract":
        at = _find(inside, "FROM")
        return [raw(macros["extract"](inside[0].text if inside[0].kind == "word" else render(inside[:1]), render(inside[at + 1 :])))], 0
    if low in _HYPOTHETICAL and len(after) > 1 and after[0].word("WITHIN") and after[1].word("GROUP"):
        return [raw(hypothetical(low, render(inside), after[2].inside))], 3
    if low == "mode" and not inside and len(after) > 1 and after[0].word("WITHIN"):
        x = [t for t in after[2].inside[2:] if t.kind != "raw" and not t.word("ASC", "DESC")]
        return [raw(f"mode({render(x)}, true)")], 3
    order = next((k for k in range(len(inside) - 1) if inside[k].word("ORDER") and inside[k + 1].word("BY")), -1)
    if low == "string_agg" and order >= 0:
        return [raw(f"listagg({render(inside[:order])}) WITHIN GROUP ({render(inside[order:])})")], 0
    if low == "array_agg" and order >= 0:
        by, down = inside[order + 2 :], any(t.word("DESC") for t in inside[order + 2 :])
        key = render([t for t in by if not t.word("ASC", "DESC", "NULLS", "FIRST", "LAST") and not (t.kind == "raw" and t.text.startswith("NULLS"))])
        return [raw(f"transform(sort_array(collect_list(struct({key} AS k, {render(inside[:order])} AS v)), {str(not down).lower()}), e -> e.v)")], 0
    if inside and inside[0].word("DISTINCT") and after and after[0].word("OVER"):
        x, over = render(inside[1:]), after[1].inside
        each = f"collect_set({x}) OVER ({render(over)})"
        if low == "count":
            return [raw(f"CAST(size({each}) AS BIGINT)")], 2
        if low == "sum":
            return [raw(f"aggregate({each}, CAST(0 AS DOUBLE), (s, v) -> s + v)")], 2
        raise DialectError(f"{low}(DISTINCT) over a window")
    if low == "xmlelement":
        args = [a[1:] if k == 0 and a[0].word("NAME") else a for k, a in enumerate(args)]
        content = [render(a) for a in args[1:] if not (a[0].word("XMLATTRIBUTES"))]
        return [raw(macros["xml_element"](quote(render(args[0]).strip("`'")), *content))], 0
    if low == "xmlforest":
        parts = []
        for a in args:
            at = _find(a, "AS")
            parts.append(macros["xml_element"](quote(render(a[at + 1 :]).strip("`") if at >= 0 else render(a[-1:])), render(a[:at] if at >= 0 else a)))
        return [raw(macros["xmlconcat"](*parts))], 0
    if low in ("xmlparse", "xmlserialize"):
        own = [t for t in inside if not t.word("DOCUMENT", "CONTENT")]
        at = _find(own, "AS")
        return [raw(f"({render(own[:at] if at >= 0 else own)})")], 0
    if low in macros and not any(t.word("FROM", "DISTINCT", "ORDER") for t in inside):
        return [raw(macros[low](*map(render, args)))], 0
    return [name, group], 0


def hypothetical(name: str, v: str, order: list[Token]) -> str:
    """The place that v would have among the ordered values."""
    by = order[2:]
    down = any(t.word("DESC") for t in by)
    x = render([t for t in by if not t.word("ASC", "DESC") and not (t.kind == "raw" and t.text.startswith("NULLS"))])
    before = f"{x} {'>' if down else '<'} {v}"
    if name == "rank":
        return f"(count_if({before}) + 1)"
    if name == "dense_rank":
        return f"(count(DISTINCT CASE WHEN {before} THEN {x} END) + 1)"
    if name == "percent_rank":
        return f"coalesce(try_divide(count_if({before}), count({x})), 0.0D)"
    return f"((count_if({before} OR {x} = {v}) + 1) / (count({x}) + 1))"


def _left(out: list[Token]) -> list[Token]:
    """Takes the operand that out ends with."""
    if not out:
        raise DialectError("an operand is missing on the left")
    t = out.pop()
    if t.kind == "(" and out and out[-1].kind in ("word", "quoted") and out[-1].text.upper() not in _NOT_NAMES:
        got = [*_name(out), t]
    elif t.word("END"):
        depth, got = 1, [t]
        while depth:
            x = out.pop()
            depth += x.word("END") - x.word("CASE")
            got.insert(0, x)
    elif t.kind in ("word", "quoted"):
        out.append(t)
        got = _name(out)
    elif t.kind == "string" and out and out[-1].word("DATE"):
        got = [out.pop(), t]
    elif t.kind in ("raw", "string", "number", "(", "dollar", "param"):
        got = [t]
    else:
        raise DialectError(f"an operand is needed, not {t.text or t.kind}")
    return got


def _name(out: list[Token]) -> list[Token]:
    got = [out.pop()]
    while len(out) >= 2 and out[-1].op("."):
        got = [*out[-2:], *got]
        del out[-2:]
    return got


def _left_expression(out: list[Token]) -> list[Token]:
    """Takes all back to the next word that no expression spans."""
    got: list[Token] = []
    while out and not (out[-1].kind == "word" and out[-1].text.upper() in _BOUNDS and not out[-1].word("END")) and not out[-1].op(",", ";") and not out[-1].op(*_COMPARE):
        if out[-1].word("END"):
            got = [*_left(out), *got]
        else:
            got.insert(0, out.pop())
    if not got:
        raise DialectError("an operand is missing on the left")
    return got


def _right(tokens: list[Token], i: int) -> tuple[list[Token], int]:
    """The operand at i and the place after it."""
    if i >= len(tokens):
        raise DialectError("an operand is missing on the right")
    t = tokens[i]
    if t.op("-", "+"):
        got, j = _right(tokens, i + 1)
        return [t, *got], j
    if t.word("CASE"):
        depth, j = 1, i + 1
        while depth:
            depth += tokens[j].word("CASE") - tokens[j].word("END")
            j += 1
        return tokens[i:j], j
    if t.word("DATE") and i + 1 < len(tokens) and tokens[i + 1].kind == "string":
        return tokens[i : i + 2], i + 2
    if t.kind in ("word", "quoted") and t.text.upper() not in _BOUNDS:
        j = i + 1
        while j + 1 < len(tokens) and tokens[j].op("."):
            j += 2
        if j < len(tokens) and tokens[j].kind == "(":
            j += 1
        return tokens[i:j], j
    if t.kind in ("raw", "string", "number", "(", "dollar", "param"):
        return [t], i + 1
    raise DialectError(f"an operand is needed, not {t.text or t.kind}")


def _arrows(tokens: list[Token]) -> list[Token]:
    """Chains of -> and their kin by constant keys become one path."""
    macros, out, i = functions.load(), [], 0
    while i < len(tokens):
        t = tokens[i]
        if not t.op(*_JSON_OPS):
            out.append(t)
            i += 1
            continue
        if t.op("->") and _is_lambda(out, tokens, i):
            out.append(t)
            i += 1
            continue
        x, keys, last = render(_left(out)), [], ""
        while i < len(tokens) and tokens[i].op(*_JSON_OPS):
            last = tokens[i].text
            key, i = _right(tokens, i + 1)
            if len(key) != 1 or key[0].kind not in ("string", "number"):
                raise DialectError(f"{last} needs a constant key, not {render(key)}")
            text = literal(key[0]) if key[0].kind == "string" else key[0].text
            keys += [s.strip().strip('"') for s in text.strip("{}").split(",")] if last[0] == "#" else [text]
        out.append(raw(macros["json_get_text" if last.endswith(">>") else "json_get"](x, *keys)))
    return out


def _is_lambda(out: list[Token], tokens: list[Token], i: int) -> bool:
    """x -> ... as a function's argument: a plain name or brackets first, and no constant key after."""
    first = len(out) == 1 or len(out) > 1 and out[-2].op(",")
    nxt = tokens[i + 1] if i + 1 < len(tokens) else None
    return first and out[-1].kind in ("word", "(") and nxt is not None and nxt.kind not in ("string", "number")


def _json_like(*sides: list[Token]) -> bool:
    for s in sides:
        if len(s) == 1 and s[0].kind == "string":
            return literal(s[0]).strip()[:1] in ("{", "[", '"') and not re.fullmatch(r"\{[^:{}\[\]]*\}", literal(s[0]).strip())
        if len(s) == 1 and s[0].kind == "raw" and (s[0].text.startswith(("to_json(", "get_json_object(")) or re.match(r"CAST\('\s*[\[{]", s[0].text)):
            return True
    return False


def _array_side(x: list[Token]) -> str:
    """An operand as an array: '{a,b}' is a constant array of texts."""
    if len(x) == 1 and x[0].kind == "string":
        return _cast(x, "ARRAY<STRING>").text
    return render(x)


def _operators(tokens: list[Token]) -> list[Token]:
    macros, out, i = functions.load(), [], 0

    def negated() -> bool:
        if out and out[-1].word("NOT"):
            out.pop()
            return True
        return False

    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
        if t.op("~", "~*", "!~", "!~*") and out:
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 1)
            p = quote(("(?i)" if "*" in t.text else "") + literal(y[0])) if len(y) == 1 and y[0].kind == "string" else f"concat('{'(?i)' if '*' in t.text else ''}', {render(y)})"
            out.append(raw(f"({'NOT ' if t.text[0] == '!' else ''}({x} RLIKE {p}))"))
        elif t.op("~~", "~~*", "!~~", "!~~*") and out:
            out += [*([Token("word", "NOT")] if t.text[0] == "!" else []), Token("word", "ILIKE" if "*" in t.text else "LIKE")]
            i += 1
        elif t.word("SIMILAR") and after and after.word("TO"):
            no = negated()
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 2)
            if len(y) != 1 or y[0].kind != "string":
                raise DialectError("SIMILAR TO needs a constant pattern")
            out.append(raw(f"({'NOT ' if no else ''}({x} RLIKE {quote(patterns.similar_to(literal(y[0])))}))"))
        elif t.word("BETWEEN") and after and after.word("SYMMETRIC"):
            no = negated()
            x = render(_left_expression(out))
            at = _find(tokens, "AND", start=i)
            a = render(tokens[i + 2 : at])
            end = at + 1
            while end < len(tokens) and not (tokens[end].kind == "word" and tokens[end].text.upper() in _BOUNDS) and not tokens[end].op(",", ";"):
                end += 1
            b = render(tokens[at + 1 : end])
            out.append(raw(f"({'NOT ' if no else ''}({x} >= {a} AND {x} <= {b} OR {x} >= {b} AND {x} <= {a}))"))
            i = end
        elif t.op(*_COMPARE) and after and after.word("ANY", "SOME", "ALL") and i + 2 < len(tokens) and tokens[i + 2].kind == "(":
            out.append(_quantified(_left_expression(out), t.text, "ALL" if after.word("ALL") else "ANY", tokens[i + 2]))
            i += 3
        elif t.op(*_COMPARE) and after and after.kind == "(" and out and out[-1].kind == "(" and len(split(after.inside)) > 1 and len(split(out[-1].inside)) == len(split(after.inside)) and not is_query(after.inside):
            pairs = [(f"({render(a)})", f"({render(b)})") for a, b in zip(split(out.pop().inside), split(after.inside), strict=True)]
            if out and out[-1].word("ROW"):
                out.pop()
            out.append(raw(row_comparison(t.text, pairs)))
            i += 2
        elif t.op("^@") and out:
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 1)
            out.append(raw(f"startswith({x}, {render(y)})"))
        elif t.op("@>", "<@") and out:
            x = _left_expression(out)
            y, i = _right(tokens, i + 1)
            big, small = (x, y) if t.text == "@>" else (y, x)
            if _json_like(x, y):
                out.append(raw(macros["json_contains"](render(big), render(small))))
            else:
                out.append(raw(macros["array_contains_all"](_array_side(big), _array_side(small))))
        elif t.op("&&") and out:
            x = _left_expression(out)
            y, i = _right(tokens, i + 1)
            out.append(raw(macros["array_overlap"](_array_side(x), _array_side(y))))
        elif t.op("?", "?|", "?&") and out:
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 1)
            name = {"?": "json_has_key", "?|": "json_has_any", "?&": "json_has_all"}[t.text]
            out.append(raw(macros[name](x, render(y) if t.text == "?" else _array_side(y))))
        elif t.op("#-") and out:
            x = render(_left(out))
            y, i = _right(tokens, i + 1)
            out.append(raw(macros["json_delete_path"](x, _array_side(y))))
        elif t.op("-") and out and after and after.kind == "string" and out[-1].kind in ("word", "quoted", "raw", "string", "(") and not (out[-1].kind == "word" and out[-1].text.upper() in _BOUNDS):
            x = render(_left(out))
            out.append(raw(macros["json_delete"](x, quote(literal(after)))))
            i += 2
        elif t.op("@@") and out:
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 1)
            out.append(raw(macros["ts_match"](x, render(y))))
        elif t.op("<->") and out:
            x = render(_left(out))
            y, i = _right(tokens, i + 1)
            out.append(raw(macros["geo_distance"](x, render(y))))
        elif t.op("~=") and out:
            x = render(_left_expression(out))
            y, i = _right(tokens, i + 1)
            out.append(raw(f"({x} = {render(y)})"))
        elif t.op("/") and out and out[-1].kind == "number" and out[-1].text.isdigit() and after and after.kind == "number" and after.text.isdigit():
            out.append(Token("word", "div"))
            i += 1
        else:
            out.append(t)
            i += 1
    return out


def row_comparison(op: str, pairs: list[tuple[str, str]]) -> str:
    """(a, b) op (c, d): equal in all, or in order of the first that differ."""
    if op in ("=", "<>", "!="):
        same = " AND ".join(f"{a} = {b}" for a, b in pairs)
        return f"({same})" if op == "=" else f"(NOT ({same}))"
    (a, b), rest = pairs[0], pairs[1:]
    return f"({a} {op} {b})" if not rest else f"({a} {op[0]} {b} OR {a} = {b} AND {row_comparison(op, rest)})"


def _quantified(x: list[Token], op: str, kind: str, group: Token) -> Token:
    left, inside = render(x), render(group.inside)
    if not is_query(group.inside) and not (group.inside and group.inside[0].kind == "raw" and group.inside[0].text.startswith("SELECT")):
        test = f"e -> {left} {op} e"
        return raw(f"exists({inside}, {test})" if kind == "ANY" else f"forall({inside}, {test})")
    if kind == "ANY" and op == "=":
        return raw(f"({left} IN ({inside}))")
    if kind == "ALL" and op in ("<>", "!="):
        return raw(f"({left} NOT IN ({inside}))")
    if op in _COMPARE and op not in ("=", "<>", "!="):
        # one aggregate of the inner side tells: its least or greatest value, its nulls and its rows
        least = (op in (">", ">=")) == (kind == "ANY")
        facts = f"SELECT min(__v) AS min_v, max(__v) AS max_v, count(*) AS n, count(__v) AS k FROM ({inside}) AS __q(__v)"
        empty, sure = ("false", "true") if kind == "ANY" else ("true", "false")
        value = lambda what: f"(SELECT {what} FROM ({facts}))"
        test = f"{left} {op} {value(f'{'min' if least else 'max'}_v')}"
        return raw(f"(CASE WHEN {value('n')} = 0 THEN {empty} WHEN ({test}) = {sure} THEN {sure} WHEN {value('n > k')} THEN NULL ELSE {test} END)")
    if kind == "ANY":
        return raw(f"EXISTS (SELECT 1 FROM ({inside}) AS __q(__v) WHERE {left} {op} __v)")
    return raw(f"NOT EXISTS (SELECT 1 FROM ({inside}) AS __q(__v) WHERE NOT coalesce({left} {op} __v, false))")
