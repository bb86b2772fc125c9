"""Statements that define things. They are methods of the engine."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engine as e
from .security import Policy, Role


def columns_of(tokens) -> tuple[str, ...]:
    return tuple(p[-1].text.strip('"').lower() for p in e.split(tokens) if p)


def _until(tokens, *words):
    """The tokens before the first of the words."""
    return tokens[: next((k for k, t in enumerate(tokens) if t.word(*words)), len(tokens))]


_COLUMN_WORDS = ("NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", "GENERATED", "CONSTRAINT", "COLLATE")


class Definitions:
    def _type(self, tokens) -> tuple[str, int, str]:
        """Spark's type, the tokens it takes, and the name of a domain or enum."""
        name = tokens[0].text.lower()
        if name in self.state.domains:
            return self.state.domains[name][0], 1, name
        if name in self.state.enums:
            return "STRING", 1, name
        kind, n = e.type_of(tokens)
        return kind, n, name

    def _column(self, tokens) -> tuple[e.ColumnDef, dict]:
        """A column's definition and the table's constraints in it."""
        name, (kind, n, declared) = tokens[0].text.strip('"').lower(), self._type(tokens[1:])
        col, rest, extra = e.ColumnDef(name, kind, declared), tokens[1 + n :], {"checks": [], "keys": [], "foreign": []}
        if declared in ("serial", "bigserial"):
            col = replace(col, not_null=True, default="__serial")
        k = 0
        while k < len(rest):
            t = rest[k]
            if t.word("NOT"):
                col, k = replace(col, not_null=True), k + 2
            elif t.word("DEFAULT"):
                value = _until(rest[k + 1 :], *_COLUMN_WORDS)
                value = value or rest[k + 1 : k + 2]
                col, k = replace(col, default=e._text(value)), k + 1 + len(value)
            elif t.word("PRIMARY"):
                extra["keys"].append((name,))
                col, k = replace(col, not_null=True), k + 2
            elif t.word("UNIQUE"):
                extra["keys"].append((name,))
                k += 1
            elif t.word("CHECK"):
                extra["checks"].append((f"{name}_check", e._text(rest[k + 1].inside)))
                k += 2
            elif t.word("REFERENCES"):
                ref, k = self._reference((name,), rest, k)
                extra["foreign"].append(ref)
            elif t.word("GENERATED"):
                group = next((x for x in rest[k:] if x.kind == "("), None)
                if any(x.word("IDENTITY") for x in rest[k:]):
                    col = replace(col, default="__serial", not_null=True)
                else:
                    col = replace(col, generated=e._text(group.inside))
                k = len(rest)
            else:
                k += 1
        return col, extra

    def _reference(self, columns, rest, k):
        target, k = self._plain(rest[k + 1].text), k + 2
        refs = ()
        if k < len(rest) and rest[k].kind == "(":
            refs, k = columns_of(rest[k].inside), k + 1
        on_delete = "NO ACTION"
        while k + 2 < len(rest) and rest[k].word("ON"):
            action = rest[k + 2].text.upper() + (" " + rest[k + 3].text.upper() if rest[k + 2].word("SET", "NO") else "")
            if rest[k + 1].word("DELETE"):
                on_delete = action
            k += 4 if rest[k + 2].word("SET", "NO") else 3
        if not refs and target in self.state.tables and self.state.tables[target].keys:
            refs = self.state.tables[target].keys[0]
        return e.ForeignKey(columns, target, refs, on_delete), k

    def _constraint(self, part, extra) -> None:
        name = ""
        if part[0].word("CONSTRAINT"):
            name, part = part[1].text, part[2:]
        if part[0].word("PRIMARY", "UNIQUE"):
            extra["keys"].append(columns_of(next(t for t in part if t.kind == "(").inside))
        elif part[0].word("CHECK"):
            extra["checks"].append((name or f"check_{len(extra['checks']) + 1}", e._text(part[1].inside)))
        elif part[0].word("FOREIGN"):
            at = next(k for k, t in enumerate(part) if t.word("REFERENCES"))
            extra["foreign"].append(self._reference(columns_of(part[2].inside), part, at)[0])

    def _empty(self, columns) -> DataFrame:
        return self.spark.sql(f"SELECT {', '.join([*(f'CAST(NULL AS {c.type}) AS `{c.name}`' for c in columns), f'CAST(NULL AS STRING) AS {e.RID}'])} LIMIT 0")

    def _do_create(self, text, tokens):
        words = [t.text.upper() for t in tokens[:8] if t.kind == "word"]
        words = [w for w in words if w not in ("CREATE", "OR", "REPLACE", "TEMP", "TEMPORARY", "UNLOGGED", "GLOBAL", "LOCAL", "RECURSIVE")]
        what = words[0]
        if what == "MATERIALIZED":
            m = re.match(r"(?is).*?MATERIALIZED\s+VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)\s+AS\s+(.*?)(?:\s+WITH\s+(NO\s+)?DATA)?$", text)
            return self._create_as(m[1], m[2], not m[3], "matview")
        if what == "VIEW":
            m = re.match(r"(?is).*?VIEW\s+([\w.\"]+)\s*(\([^)]*\))?\s+AS\s+(.*)", text)
            name, query = self._plain(m[1]), m[3]
            if m[2]:
                query = f"SELECT * FROM ({query}) AS v{m[2]}"
            df = self.query(query)
            self.state.tables[name] = e.Table(name, None, tuple(e.ColumnDef(f.name, f.dataType.simpleString()) for f in df.schema), "view", query, owner=self.role)
            return e.Result("CREATE VIEW")
        if what == "TABLE":
            return self._create_table(text)
        if what == "SEQUENCE":
            name = re.match(r"(?is).*?SEQUENCE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)", text)[1]
            start, by = re.search(r"(?i)START\s+(?:WITH\s+)?(-?\d+)", text), re.search(r"(?i)INCREMENT\s+(?:BY\s+)?(-?\d+)", text)
            self.state.sequences[name] = [int(start[1]) if start else 1, int(by[1]) if by else 1, 0]
            return e.Result("CREATE SEQUENCE")
        if what == "SCHEMA":
            self.state.schemas.add(tokens[-1].text.lower())
            return e.Result("CREATE SCHEMA")
        if what == "TYPE":
            tree = e.parse(text)
            if any(t.word("ENUM") for t in tree):
                self.state.enums[tree[2].text.lower()] = tuple(e.literal(p[0]) for p in e.split(tree[-1].inside))
            return e.Result("CREATE TYPE")
        if what == "DOMAIN":
            tree = [t for t in e.parse(text) if not t.word("AS")]
            kind, n, _ = self._type(tree[3:])
            check = next((e._text(tree[k + 1].inside) for k, t in enumerate(tree) if t.word("CHECK")), "")
            self.state.domains[tree[2].text.lower()] = (kind, any(t.word("NOT") for t in tree[3 + n :]), check)
            return e.Result("CREATE DOMAIN")
        if what in ("ROLE", "USER"):
            name = tokens[2].text.lower()
            self.state.auth.roles[name] = Role(name)
            self._role_options(name, [t.text.upper() for t in tokens[3:]], what == "USER")
            return e.Result("CREATE ROLE")
        if what == "POLICY":
            return self._create_policy(text)
        if what == "FUNCTION":
            return self._create_function(text)
        if what == "AGGREGATE":
            m = re.match(r"(?is).*?AGGREGATE\s+(\w+)\s*\([^)]*\)\s*\((.*)\)$", text)
            own = {k.strip().lower(): v.strip().strip("'") for k, v in (x.split("=", 1) for x in m[2].split(","))}
            self.aggregates[m[1].lower()] = (own["sfunc"], own.get("initcond", "0"), own.get("finalfunc"))
            return e.Result("CREATE AGGREGATE")
        if what == "TRIGGER":
            m = re.match(r"(?is).*?TRIGGER\s+(\w+)\s+(BEFORE|AFTER)\s+(.+?)\s+ON\s+([\w.]+)\s.*?EXECUTE\s+(?:FUNCTION|PROCEDURE)\s+(\w+)\s*\((.*)\)$", text)
            t = self._get(self._plain(m[4]))
            self.state.tables[t.name] = replace(t, triggers=(*t.triggers, (m[1].lower(), f"{m[2].upper()} {m[3].upper()}", m[5].lower(), m[6])))
            return e.Result("CREATE TRIGGER")
        if what == "RULE":
            m = re.match(r"(?is).*?RULE\s+(\w+)\s+AS\s+ON\s+(\w+)\s+TO\s+([\w.]+)\s+DO\s+(ALSO|INSTEAD)?\s*(.*)$", text)
            t = self._get(self._plain(m[3]))
            self.state.tables[t.name] = replace(t, rules=(*t.rules, (m[1].lower(), m[2].upper(), (m[4] or "").upper() == "INSTEAD", m[5].strip()[1:-1] if m[5].strip().startswith("(") else m[5].strip())))
            return e.Result("CREATE RULE")
        if what in ("CONVERSION", "ACCESS", "TRANSFORM", "PROCEDURE"):
            return e.Result(f"CREATE {what}")
        raise e.DialectError(f"unknown CREATE {what}")

    def _create_as(self, name: str, query: str, data: bool, kind: str = "table"):
        name = self._plain(name)
        df = self.query(query)
        df = (df if data else df.limit(0)).withColumn(e.RID, F.expr("uuid()"))
        columns = tuple(e.ColumnDef(f.name.lower(), f.dataType.simpleString()) for f in df.schema if f.name != e.RID)
        self.state.tables[name] = e.Table(name, e.written(df, name), columns, kind, query, owner=self.role)
        return e.Result("SELECT")

    def _do_refresh(self, text, tokens):
        t = self._get(tokens[-1].text)
        self.state.tables[t.name] = replace(t, df=e.written(self.query(t.query).withColumn(e.RID, F.expr("uuid()")), t.name))
        return e.Result("REFRESH MATERIALIZED VIEW")

    def _create_table(self, text):
        m = re.match(r"(?is).*?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)\s*(.*)$", text)
        name, rest = self._plain(m[2]), m[3]
        if self._known(name):
            if m[1]:
                return e.Result("CREATE TABLE")
            raise e.EngineError(f"relation {name} already exists")
        if re.match(r"(?is)(\([\w\s,\"]*\)\s*)?AS\s", rest):
            own = re.match(r"(?is)(?:\(([^)]*)\)\s*)?AS\s+(.*?)(?:\s+WITH\s+(NO\s+)?DATA)?$", rest)
            return self._create_as(name, f"SELECT * FROM ({own[2]}) AS q({own[1]})" if own[1] else own[2], not own[3])
        if part := re.match(r"(?is)PARTITION\s+OF\s+([\w.]+)\s+(.*)$", rest):
            parent = self._get(self._plain(part[1]))
            self.state.tables[name] = replace(parent, name=name, df=self._empty(parent.columns), kind="table", parent=parent.name, bound=part[2], method="", part_keys=())
            return e.Result("CREATE TABLE")
        tree = e.parse(rest)
        columns, extra = [], {"checks": [], "keys": [], "foreign": []}
        for item in e.split(tree[0].inside):
            if item[0].word("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                self._constraint(item, extra)
            elif item[0].word("LIKE"):
                other = self._get(self._plain(item[1].text))
                columns += other.columns
            else:
                col, own = self._column(item)
                columns.append(col)
                for k in extra:
                    extra[k] += own[k]
        at = next((k for k, t in enumerate(tree) if t.word("INHERITS")), -1)
        parent = None
        if at >= 0:
            parent = self._plain(tree[at + 1].inside[0].text)
            mine = {c.name for c in columns}
            columns = [c for c in self._get(parent).columns if c.name not in mine] + columns
        keyed = {c for k in extra["keys"][:0] for c in k}
        at = next((k for k, t in enumerate(tree) if t.word("PARTITION")), -1)
        method, part_keys = (tree[at + 2].text.upper(), columns_of(tree[at + 3].inside)) if at >= 0 else ("", ())
        columns = tuple(replace(c, not_null=c.not_null or c.name in keyed) for c in columns)
        self.state.tables[name] = e.Table(name, self._empty(columns), columns, "partitioned" if method else "table", "", tuple(extra["checks"]), tuple(extra["keys"]), tuple(extra["foreign"]), self.role, parent, "", method, part_keys)
        return e.Result("CREATE TABLE")

    def _do_drop(self, text, tokens):
        m = re.match(r"(?is)DROP\s+(MATERIALIZED\s+VIEW|\w+)\s+(IF\s+EXISTS\s+)?(.*?)(\s+CASCADE|\s+RESTRICT)?$", text)
        what, names = m[1].upper(), [x.strip() for x in re.sub(r"\([^)]*\)", "", m[3]).split(",")]
        for name in names:
            plain = self._plain(name.split()[0])
            if what in ("TABLE", "VIEW") or what.startswith("MATERIALIZED"):
                if (self.state.tables.pop(plain, None) or self.state.lazy.pop(plain, None)) is None and not m[2]:
                    raise e.EngineError(f"relation {plain} does not exist")
                self.state.lazy.pop(plain, None)
                for child in [c.name for c in self.state.tables.values() if c.parent == plain]:
                    self.state.tables.pop(child)
                self.spark.catalog.dropTempView(plain)
            elif what == "SEQUENCE":
                self.state.sequences.pop(plain, None)
            elif what == "SCHEMA":
                self.state.schemas.discard(plain)
            elif what in ("TYPE", "DOMAIN"):
                self.state.enums.pop(plain, None)
                self.state.domains.pop(plain, None)
            elif what in ("ROLE", "USER"):
                self.state.auth.roles.pop(plain, None)
            elif what in ("FUNCTION", "AGGREGATE"):
                if self.functions.pop(plain, None):
                    self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {plain}")
                self.aggregates.pop(plain, None)
            elif what in ("TRIGGER", "POLICY", "RULE"):
                own, table = re.match(r"(?is)(\w+)\s+ON\s+([\w.]+)", name).groups()
                t = self._get(self._plain(table))
                if what == "POLICY":
                    self.state.auth.policies[t.name] = [p for p in self.state.auth.policies.get(t.name, []) if p.name != own.lower()]
                else:
                    field = "triggers" if what == "TRIGGER" else "rules"
                    self.state.tables[t.name] = replace(t, **{field: tuple(x for x in getattr(t, field) if x[0] != own.lower())})
        return e.Result(f"DROP {what}")

    def _do_alter(self, text, tokens):
        what = tokens[1].text.upper()
        if what in ("ROLE", "USER"):
            self._role_options(self.state.auth.known(tokens[2].text), [t.text.upper() for t in tokens[3:]], False)
            return e.Result("ALTER ROLE")
        if what == "TYPE":
            name, value = tokens[2].text.lower(), next(e.literal(t) for t in tokens if t.kind == "string")
            values = [*self.state.enums[name]]
            near = [e.literal(t) for t in tokens if t.kind == "string"]
            at = len(values) if len(near) < 2 else values.index(near[1]) + any(t.word("AFTER") for t in tokens)
            self.state.enums[name] = (*values[:at], value, *values[at:])
            return e.Result("ALTER TYPE")
        if what in ("FUNCTION", "AGGREGATE"):
            m = re.match(r"(?is).*?FUNCTION\s+(\w+).*?RENAME\s+TO\s+(\w+)", text)
            if m:
                args, ret, body = self.functions.pop(m[1].lower())
                self._define(m[2].lower(), args, ret, body)
            return e.Result("ALTER FUNCTION")
        if what != "TABLE":
            return e.Result(f"ALTER {what}")
        m = re.match(r"(?is)ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+(.*)$", text)
        for action in e.split(e.parse(m[2])):
            self._alter_table(self._plain(m[1]), action)
        return e.Result("ALTER TABLE")

    def _alter_table(self, name, a) -> None:
        t, put = self._get(name), lambda t: self.state.tables.__setitem__(t.name, t)
        word, last = lambda k, *w: k < len(a) and a[k].word(*w), a[-1].text.strip('"').lower()
        skip = 2 if word(1, "COLUMN") else 1
        while word(skip, "IF", "NOT", "EXISTS"):
            skip += 1
        if word(0, "ADD") and word(1, "CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
            extra = {"checks": [], "keys": [], "foreign": []}
            self._constraint(a[1:], extra)
            new = replace(t, checks=(*t.checks, *extra["checks"]), keys=(*t.keys, *extra["keys"]), foreign=(*t.foreign, *extra["foreign"]))
            self._validate(new, new.df)
            put(new)
        elif word(0, "ADD"):
            col, extra = self._column(a[skip:])
            value = f"CAST({e.expression(col.generated or col.default or 'NULL')} AS {col.type})"
            put(replace(t, columns=(*t.columns, col), df=t.df.withColumn(col.name, F.expr(value)), checks=(*t.checks, *extra["checks"]), keys=(*t.keys, *extra["keys"])))
        elif word(0, "DROP") and word(1, "CONSTRAINT"):
            put(replace(t, checks=tuple(c for c in t.checks if c[0].lower() != last)))
        elif word(0, "DROP"):
            own = a[skip].text.strip('"').lower()
            put(replace(t, columns=tuple(c for c in t.columns if c.name != own), df=t.df.drop(own)))
        elif word(0, "RENAME") and word(1, "TO"):
            self.state.tables.pop(t.name)
            self.state.lazy.pop(t.name, None)
            put(replace(t, name=last))
        elif word(0, "RENAME"):
            own = a[skip].text.strip('"').lower()
            put(replace(t, columns=tuple(replace(c, name=last) if c.name == own else c for c in t.columns), df=t.df.withColumnRenamed(own, last)))
        elif word(0, "ALTER"):
            own, rest = a[skip].text.strip('"').lower(), a[skip + 1 :]
            col = next(c for c in t.columns if c.name == own)
            df = t.df
            if any(x.word("TYPE") for x in rest):
                col = replace(col, type=e.type_of(rest[[x.word("TYPE") for x in rest].index(True) + 1 :])[0])
                df = df.withColumn(own, F.col(own).cast(col.type))
            elif rest[1].word("DEFAULT"):
                col = replace(col, default=e._text(rest[2:]) if rest[0].word("SET") else None)
            elif rest[1].word("NOT"):
                col = replace(col, not_null=rest[0].word("SET"))
            new = replace(t, df=df, columns=tuple(col if c.name == own else c for c in t.columns))
            self._validate(new, df)
            put(new)
        elif word(0, "ENABLE", "FORCE") and any(x.word("SECURITY") for x in a):
            self.state.auth.secured.add(t.name)
        elif word(0, "DISABLE") and any(x.word("SECURITY") for x in a):
            self.state.auth.secured.discard(t.name)
        elif word(0, "OWNER"):
            put(replace(t, owner=last))
        elif word(0, "ATTACH"):
            part = self._get(self._plain(a[2].text))
            put(replace(part, parent=t.name, bound=e._text(a[3:])))
        elif word(0, "DETACH"):
            put(replace(self._get(self._plain(a[2].text)), parent=None, bound=""))

    # security

    def _role_options(self, name, words, user) -> None:
        r = self.state.auth.roles[name]
        r.login = (r.login or user or "LOGIN" in words) and "NOLOGIN" not in words
        r.superuser = (r.superuser or "SUPERUSER" in words) and "NOSUPERUSER" not in words
        r.bypass_rls = (r.bypass_rls or "BYPASSRLS" in words) and "NOBYPASSRLS" not in words

    def _grant(self, text, give: bool):
        m = re.match(r"(?is)(?:GRANT|REVOKE)\s+(.*?)\s+ON\s+(?:TABLE\s+)?([\w., \"]+?)\s+(?:TO|FROM)\s+([\w, \"]+?)(?:\s+WITH\s+GRANT\s+OPTION|\s+CASCADE)?$", text)
        auth = self.state.auth
        if not m:
            m = re.match(r"(?is)(?:GRANT|REVOKE)\s+([\w, ]+?)\s+(?:TO|FROM)\s+([\w, ]+)$", text)
            for role in m[2].split(","):
                for group in m[1].split(","):
                    members = auth.roles[auth.known(role.strip())].members_of
                    members.add(auth.known(group.strip())) if give else members.discard(group.strip().lower())
            return e.Result("GRANT ROLE" if give else "REVOKE ROLE")
        for part in e.split(e.parse(m[1])):
            name = "ALL" if part[0].word("ALL") else part[0].text.upper()
            own = {f"{name}:{c}" for c in columns_of(part[-1].inside)} if part[-1].kind == "(" else {name}
            for relation in m[2].split(","):
                for role in m[3].split(","):
                    key = (role.strip().lower(), self._plain(relation.strip()))
                    held = auth.grants.setdefault(key, set())
                    if give:
                        held |= own
                    elif name == "ALL":
                        held.clear()
                    else:
                        if "ALL" in held:
                            held.discard("ALL")
                            held |= {"SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER"}
                        held -= own
        return e.Result("GRANT" if give else "REVOKE")

    def _do_grant(self, text, tokens):
        return self._grant(text, True)

    def _do_revoke(self, text, tokens):
        return self._grant(text, False)

    def _create_policy(self, text):
        tree = e.parse(text)
        at = {t.text.upper(): k for k, t in enumerate(tree) if t.kind == "word" and t.text.upper() in ("ON", "AS", "FOR", "TO", "USING", "CHECK")}
        p = Policy(tree[2].text.lower(), self._plain(tree[at["ON"] + 1].text))
        p.permissive = not ("AS" in at and tree[at["AS"] + 1].word("RESTRICTIVE"))
        p.command = tree[at["FOR"] + 1].text.upper() if "FOR" in at else "ALL"
        if "TO" in at:
            p.roles = tuple(t.text.lower() for t in _until(tree[at["TO"] + 1 :], "USING", "WITH") if t.kind == "word")
        p.using = e._text(tree[at["USING"] + 1].inside) if "USING" in at else None
        p.check = e._text(tree[at["CHECK"] + 1].inside) if "CHECK" in at else None
        self.state.auth.policies.setdefault(p.table, []).append(p)
        return e.Result("CREATE POLICY")

    # functions

    def _create_function(self, text):
        m = re.match(r"(?is).*?FUNCTION\s+([\w.]+)\s*\((.*?)\)\s*RETURNS\s+(SETOF\s+)?(TABLE\s*\([^)]*\)|[\w\[\]]+(?:\s*\([^)]*\))?)\s+(.*)$", text)
        name, rest = m[1].lower(), e.flat(m[5])
        body = next((e.literal(t) for t in rest if t.kind in ("dollar", "string") and not (t.kind == "string" and rest[rest.index(t) - 1].word("LANGUAGE"))), "")
        language = next((rest[k + 1].text.strip("'").lower() for k, t in enumerate(rest) if t.word("LANGUAGE")), "sql")
        args = [" ".join(x.text for x in p) for p in e.split(e.flat(m[2]))] if m[2].strip() else []
        if language == "plpgsql":
            from .scripting import Procedure

            self.functions[name] = (args, m[4], body)
            self.procedures[name] = Procedure(self, args, body)
            return e.Result("CREATE FUNCTION")
        if language != "sql":
            raise e.EngineError(f"language {language} is not known; register a Python function instead")
        self._define(name, args, m[4], body)
        return e.Result("CREATE FUNCTION")

    def _define(self, name, args, returns, body) -> None:
        """A SQL function is inlined by Catalyst: an expression, or a query of a table function."""
        named = [(a.split()[0] if len(a.split()) > 1 else f"arg{k + 1}", self._type(e.parse(a)[-1:] if len(a.split()) == 1 else e.parse(a)[1:])[0]) for k, a in enumerate(args)]
        body = re.sub(r"\$(\d+)", lambda m: named[int(m[1]) - 1][0], body.strip().rstrip(";"))
        kinds = ", ".join(f"{n} {k}" for n, k in named)
        self._names(e.flat(body))
        if returns.upper().startswith("TABLE"):
            inner = e.parse(returns)[1].inside
            kind = "TABLE (" + ", ".join(f"{p[0].text} {self._type(p[1:])[0]}" for p in e.split(inner)) + ")"
            made = e.rewrite(body)
        else:
            kind = self._type(e.parse(returns))[0]
            own = re.match(r"(?is)SELECT\s+((?:(?!\bFROM\b).)*)$", body)
            made = e.expression(own[1]) if own else f"({e.rewrite(body)})"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({kinds}) RETURNS {kind} RETURN {made}")
        self.functions[name] = (args, returns, body)

    def _do_do(self, text, tokens):
        from .scripting import Procedure

        Procedure(self, [], next(e.literal(t) for t in tokens if t.kind in ("dollar", "string"))).run([])
        return e.Result("DO")

    def call(self, name: str, *args):
        """A procedural function on the driver, with its return value."""
        return self.procedures[name.lower()].run(list(args))

    def aggregate(self, name: str, x: str):
        """A column of CREATE AGGREGATE's fold over x, for agg(); it gathers a group's values, so groups must be bounded."""
        sfunc, start, final = self.aggregates[name.lower()]
        step = {"int4pl": "a + v", "int8pl": "a + v", "float8pl": "a + v", "numeric_add": "a + v", "int4larger": "greatest(a, v)", "int4smaller": "least(a, v)", "textcat": "concat(a, v)"}.get(sfunc, f"{sfunc}(a, v)")
        return F.expr(f"aggregate(array_sort(collect_list({x})), CAST('{start}' AS {'STRING' if sfunc == 'textcat' else 'DOUBLE'}), (a, v) -> {e.expression(step)}{f', a -> {final}(a)' if final else ''})")
