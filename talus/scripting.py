"""Procedural blocks: a small interpreter that runs on the driver. Its expressions and statements are the engine's SQL, with variables as literals."""

from __future__ import annotations

import datetime
import decimal

from typing import Any

from pyspark.sql import DataFrame, Row

from . import engine as e
from .dialect.tokens import Token, flat, literal


class Raised(RuntimeError):
    """RAISE EXCEPTION."""


class _Exit(Exception):
    def __init__(self, label: str, again: bool):
        self.label, self.again = label, again


class _Return(Exception):
    pass


def sql_literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"({v})" if v < 0 else str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"CAST('{v}' AS {'timestamp' if isinstance(v, datetime.datetime) else 'date'})"
    if isinstance(v, (list, tuple)):
        return f"ARRAY[{', '.join(map(sql_literal, v))}]"
    return "'" + str(v).replace("'", "''") + "'"


class Procedure:
    """args: "name type" texts. notices: what RAISE NOTICE said."""

    def __init__(self, engine: e.Engine, args: list[str], body: str):
        self.engine, self.args = engine, [a.split()[0].lower() for a in args]
        self.tokens, self.at = flat(body), 0
        self.notices: list[str] = []
        self.block = self._block()

    # parsing

    def _is(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].word(*words)

    def _take(self, *words: str) -> Token:
        t = self.tokens[self.at]
        if words and not t.word(*words):
            raise e.DialectError(f"{' or '.join(words)} is needed, not {t.text}")
        self.at += 1
        return t

    def _until(self, *words: str, mark: str = "") -> list[Token]:
        """Tokens up to one of the words or the mark, which stays, outside brackets and CASE."""
        out, depth = [], 0
        while True:
            t = self.tokens[self.at]
            if depth == 0 and (t.word(*words) or mark and t.op(mark)):
                return out
            depth += (t.text in "([" and t.kind == "mark") - (t.text in ")]" and t.kind == "mark")
            if t.word("CASE"):
                depth += 1
            elif t.word("END") and depth:
                depth -= 1
            out.append(t)
            self.at += 1

    def _line(self) -> list[Token]:
        out = self._until(mark=";")
        self.at += 1
        return out

    def _block(self):
        names = []
        if self._is("DECLARE"):
            self.at += 1
            while not self._is("BEGIN"):
                line = [t for t in self._line() if not t.word("CONSTANT")]
                cut = next((k for k, t in enumerate(line) if t.op(":=", "=") or t.word("DEFAULT")), len(line))
                names.append((line[0].text.lower(), line[cut + 1 :]))
        self._take("BEGIN")
        body, handlers = self._body("END", "EXCEPTION"), []
        if self._is("EXCEPTION"):
            self.at += 1
            while self._is("WHEN"):
                self.at += 1
                what = [t.text.lower() for t in self._until("THEN") if t.kind == "word" and not t.word("OR")]
                self._take("THEN")
                handlers.append((what, self._body("WHEN", "END")))
        self._take("END")
        if self.at < len(self.tokens) and self.tokens[self.at].op(";"):
            self.at += 1
        return ("block", names, body, handlers)

    def _body(self, *ends: str) -> list:
        out = []
        while not self._is(*ends):
            out.append(self._statement())
        return out

    def _end(self, word: str) -> None:
        self._take("END")
        self._take(word)
        self._line()

    def _statement(self):
        label = ""
        if self.tokens[self.at].op("<") or self.tokens[self.at].text == "<<":
            self.at += 2
            label = self._take().text.lower()
            self.at += 2
        t = self.tokens[self.at]
        if t.word("DECLARE", "BEGIN"):
            return self._block()
        if t.word("IF"):
            arms, other = [], []
            self.at += 1
            while True:
                test = self._until("THEN")
                self._take("THEN")
                arms.append((test, self._body("ELSIF", "ELSEIF", "ELSE", "END")))
                if self._is("ELSIF", "ELSEIF"):
                    self.at += 1
                    continue
                break
            if self._is("ELSE"):
                self.at += 1
                other = self._body("END")
            self._end("IF")
            return ("if", arms, other)
        if t.word("CASE"):
            self.at += 1
            x, arms, other = self._until("WHEN"), [], None
            while self._is("WHEN"):
                self.at += 1
                test = self._until("THEN")
                self._take("THEN")
                test = [Token("mark", "("), *x, Token("mark", ")"), Token("op", "="), Token("mark", "("), *test, Token("mark", ")")] if x else test
                arms.append((test, self._body("WHEN", "ELSE", "END")))
            if self._is("ELSE"):
                self.at += 1
                other = self._body("END")
            self._end("CASE")
            return ("if", arms, [("missing",)] if other is None else other)
        if t.word("LOOP", "WHILE", "FOR", "FOREACH"):
            self.at += 1
            if t.word("LOOP"):
                head = ("loop", label, None)
            elif t.word("WHILE"):
                head = ("while", label, self._until("LOOP"))
            else:
                name = self._take().text.lower()
                if t.word("FOREACH") and self._is("SLICE"):
                    self.at += 2
                self._take("IN")
                over = self._until("LOOP")
                head = ("each" if t.word("FOREACH") else "for", label, (name, over))
            if not t.word("LOOP"):
                self._take("LOOP")
            body = self._body("END")
            self._end("LOOP")
            return (*head, body)
        return ("line", self._line())

    # running

    def run(self, values: list):
        self.out, self.value = [], None
        self.notices.clear()
        scope = {n: v for n, v in zip(self.args, values, strict=True)} | {f"${k + 1}": v for k, v in enumerate(values)} | {"found": False}
        try:
            self._do(self.block, scope)
        except _Return:
            pass
        return self.out or self.value

    def _sql(self, tokens: list[Token], scope: dict) -> str:
        out, k = [], 0
        while k < len(tokens):
            t, name = tokens[k], tokens[k].text.lower()
            field = tokens[k + 2].text.lower() if k + 2 < len(tokens) and tokens[k + 1].op(".") else ""
            plain = t.kind in ("word", "param") and not (out and out[-1] == ".") and not (k + 1 < len(tokens) and tokens[k + 1].op("("))
            if plain and name in scope and isinstance(scope[name], Row) and field:
                out.append(sql_literal({c.lower(): v for c, v in scope[name].asDict().items()}[field]))
                k += 3
                continue
            out.append(sql_literal(scope[name]) if plain and name in scope and not field else t.text)
            k += 1
        return " ".join(out)

    def _value(self, tokens: list[Token], scope: dict):
        if len(tokens) == 1 and tokens[0].kind in ("word", "param") and tokens[0].text.lower() in scope:
            return scope[tokens[0].text.lower()]
        if len(tokens) == 1 and tokens[0].kind == "number" and tokens[0].text.isdigit():
            return int(tokens[0].text)
        head = "" if tokens and tokens[0].word("SELECT") else "SELECT "
        row = self.engine.query(head + self._sql(tokens, scope)).first()
        return row[0] if row else None

    def _all(self, body: list, scope: dict) -> None:
        for s in body:
            self._do(s, scope)

    def _round(self, label: str, body: list, scope: dict) -> bool:
        """One round of a loop; false ends it."""
        try:
            self._all(body, scope)
        except _Exit as x:
            if x.label not in ("", label):
                raise
            return x.again
        return True

    def _do(self, s: tuple, scope: dict) -> None:
        kind = s[0]
        if kind == "block":
            for name, start in s[1]:
                scope[name] = self._value(start, scope) if start else None
            saved = self.engine.state.saved() if s[3] else None
            try:
                self._all(s[2], scope)
            except (_Exit, _Return):
                raise
            except Exception as x:
                for what, body in s[3]:
                    if "others" in what or type(x).__name__.lower() in what or isinstance(x, Raised) and "raise_exception" in what or "division_by_zero" in what and "DIVIDE_BY_ZERO" in str(x):
                        self.engine.state, self.engine.failed = saved, False
                        scope["sqlerrm"] = str(x)
                        self._all(body, scope)
                        return
                raise
        elif kind == "if":
            for test, body in s[1]:
                if self._value(test, scope):
                    return self._all(body, scope)
            self._all(s[2], scope)
        elif kind == "missing":
            raise Raised("case not found")
        elif kind == "loop":
            while self._round(s[1], s[3], scope):
                pass
        elif kind == "while":
            while self._value(s[2], scope) and self._round(s[1], s[3], scope):
                pass
        elif kind == "each":
            for v in self._value([t for t in s[2][1] if not t.word("ARRAY") or len(s[2][1]) == 1], scope) or []:
                scope[s[2][0]] = v
                if not self._round(s[1], s[3], scope):
                    return
        elif kind == "for":
            for v in self._range(s[2][1], scope):
                scope[s[2][0]] = v
                if not self._round(s[1], s[3], scope):
                    return
        else:
            self._one(s[1], scope)
        return None

    def _range(self, over: list[Token], scope: dict):
        at = next((k for k, t in enumerate(over) if t.op("..")), -1)
        if at < 0:
            return self.engine.query(self._sql(over, scope)).toLocalIterator()
        back = over[0].word("REVERSE")
        by = next((k for k, t in enumerate(over) if t.word("BY")), len(over))
        step = int(self._value(over[by + 1 :], scope)) if by < len(over) else 1
        a, b = int(self._value(over[back:at], scope)), int(self._value(over[at + 1 : by], scope))
        return range(a, b - 1, -step) if back else range(a, b + 1, step)

    def _one(self, line: list[Token], scope: dict) -> None:
        t = line[0]
        if len(line) > 1 and line[1].op(":=", "=") and t.kind == "word":
            scope[t.text.lower()] = self._value(line[2:], scope)
        elif t.word("NULL"):
            pass
        elif t.word("EXIT", "CONTINUE"):
            when = next((k for k, x in enumerate(line) if x.word("WHEN")), len(line))
            if when == len(line) or self._value(line[when + 1 :], scope):
                raise _Exit(line[1].text.lower() if when > 1 else "", t.word("CONTINUE"))
        elif t.word("RETURN"):
            if len(line) > 1 and line[1].word("NEXT"):
                self.out.append(self._value(line[2:], scope))
                return
            if len(line) > 1 and line[1].word("QUERY"):
                self.out += self.engine.query(self._sql(line[2:], scope)).collect()
                return
            self.value = self._value(line[1:], scope) if len(line) > 1 else None
            raise _Return
        elif t.word("RAISE"):
            level = line[1].text.upper() if len(line) > 1 and line[1].kind == "word" else "EXCEPTION"
            texts = [x for x in line if x.kind == "string"]
            args = [p for p in e.split(line[line.index(texts[0]) + 1 :])[1:]] if texts else []
            text = literal(texts[0]) if texts else "raised"
            for a in args:
                text = text.replace("%", str(self._value(a, scope)), 1)
            if level == "EXCEPTION":
                raise Raised(text)
            self.notices.append(text)
        elif t.word("PERFORM"):
            scope["found"] = self.engine.query("SELECT " + self._sql(line[1:], scope)).limit(1).count() > 0
        elif t.word("EXECUTE"):
            into = next((k for k, x in enumerate(line) if x.word("INTO")), len(line))
            using = next((k for k, x in enumerate(line) if x.word("USING")), len(line))
            sql = str(self._value(line[1 : min(into, using)], scope))
            for k, a in enumerate(e.split(line[using + 1 :])):
                sql = sql.replace(f"${k + 1}", sql_literal(self._value(a, scope)))
            got = self.engine.sql(sql)
            if into < len(line) and isinstance(got, DataFrame):
                row = got.first()
                scope[line[into + 1].text.lower()] = row[0] if row else None
        else:
            into = next((k for k, x in enumerate(line) if x.word("INTO")), -1) if t.word("SELECT") else -1
            if into >= 0:
                stop = next((k for k in range(into, len(line)) if line[k].word("FROM", "WHERE")), len(line))
                row = self.engine.query(self._sql([*line[:into], *line[stop:]], scope)).first()
                names = [p[0].text.lower() for p in e.split([x for x in line[into + 1 : stop] if not x.word("STRICT")])]
                for k, n in enumerate(names):
                    scope[n] = None if row is None else row if len(names) == 1 and len(row) > 1 else row[k]
                scope["found"] = row is not None
            else:
                got = self.engine.sql(self._sql(line, scope))
                scope["found"] = not isinstance(got, DataFrame) and got.count > 0



