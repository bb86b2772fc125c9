"""The engine: SQL of the dialect over tables that are versions of Parquet data.

A table is an immutable value: a DataFrame and its declarations. A statement that changes data makes a new version, written to the shared
folder; a transaction is the dictionary of values that ROLLBACK puts back. Queries are rewritten where Spark's grammar differs and then left to Catalyst.
"""

from __future__ import annotations

import copy as copies
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import security
from .dialect.membership import equal_joins
from .dialect.rewrite import TYPES, expression, is_query, rewrite, type_of
from .dialect.tokens import DialectError, Token, flat, literal, parse, quote, render, split, statements
from .functions import udfs
from .plans.recursion import fixpoint
from .session import configure, ship, written
from .sources import copy, dump

RID = "__rid"


class EngineError(RuntimeError):
    """A statement that can't be done."""


class ConstraintError(EngineError):
    """A constraint that a statement would break."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    declared: str = ""
    not_null: bool = False
    default: str | None = None
    generated: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = "NO ACTION"


@dataclass(frozen=True)
class Table:
    """kind: table, view, matview or partitioned. df has RID beside the columns."""

    name: str
    df: DataFrame | None = None
    columns: tuple[ColumnDef, ...] = ()
    kind: str = "table"
    query: str = ""
    checks: tuple[tuple[str, str], ...] = ()
    keys: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    owner: str = "admin"
    parent: str | None = None
    bound: str = ""
    method: str = ""
    part_keys: tuple[str, ...] = ()
    triggers: tuple[tuple[str, str, str, str], ...] = ()
    rules: tuple[tuple[str, str, bool, str], ...] = ()

    def schema(self) -> T.StructType:
        return self.df.drop(RID).schema


@dataclass
class Result:
    """What a statement gives: a message, the rows it touched, and a DataFrame where it has one."""

    message: str
    count: int = 0
    df: DataFrame | None = None
    lines: DataFrame | None = None


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    #: Tables that are read when a statement first names them.
    lazy: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    domains: dict[str, tuple[str, bool, str]] = field(default_factory=dict)
    sequences: dict[str, list[int]] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public"})
    auth: security.Auth = field(default_factory=security.Auth)

    def saved(self) -> State:
        return State(dict(self.tables), dict(self.lazy), dict(self.enums), dict(self.domains), {k: [*v] for k, v in self.sequences.items()}, set(self.schemas), copies.deepcopy(self.auth))


_NO_OPS = re.compile(r"(?i)^(VACUUM|ANALYZE|CLUSTER|REINDEX|LISTEN|UNLISTEN|NOTIFY|CHECKPOINT|DISCARD|LOCK|COMMENT|SECURITY\s+LABEL|(CREATE|DROP|ALTER)\s+(UNIQUE\s+)?(INDEX|EXTENSION|PUBLICATION|SUBSCRIPTION|TABLESPACE|EVENT\s+TRIGGER|FOREIGN|SERVER|USER\s+MAPPING|COLLATION|OPERATOR|CAST|LANGUAGE|STATISTICS|TEXT\s+SEARCH))\b")
_CATALOGS = {"information_schema.tables", "information_schema.columns", "information_schema.schemata", "pg_tables", "pg_indexes", "pg_views", "pg_roles", "pg_stat_user_tables", "pg_namespace", "pg_stat_statements"}


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark = configure(spark)
        ship(spark)
        udfs.register(spark)
        self.state, self.saved, self.failed = State(), [], False
        self.settings: dict[str, str] = {"server_version": "16.0", "client_encoding": "UTF8", "search_path": "public", "timezone": "UTC"}
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, Iterator[Row]] = {}
        self.functions: dict[str, tuple[list[str], str, str]] = {}
        self.aggregates: dict[str, tuple[str, str, str | None]] = {}
        self.procedures: dict = {}
        self.trigger_functions: dict[str, Callable[[DataFrame, str], DataFrame | None]] = {}
        self.statistics: dict[str, list] = {}
        self.role = "admin"
        if sf_dir:
            from .session import TABLES, table

            self.state.lazy = {name: lambda name=name: table(spark, sf_dir, name) for name in TABLES}

    # tables

    def register(self, name: str, df: DataFrame) -> None:
        """df under a name, as it is: it isn't copied until a statement changes it."""
        self.state.tables[name.lower()] = Table(name.lower(), df, tuple(ColumnDef(f.name, f.dataType.simpleString()) for f in df.schema))

    def _known(self, name: str) -> bool:
        """Whether there is such a relation; a lazy one is read now."""
        if name not in self.state.tables and name in self.state.lazy:
            self.register(name, self.state.lazy[name]())
        return name in self.state.tables

    def _get(self, name: str) -> Table:
        self._known(name.lower())
        t = self.state.tables.get(name.lower())
        if t is None:
            raise EngineError(f"relation {name} does not exist")
        return t

    def table(self, name: str) -> DataFrame:
        """The rows of a table or view that the present role may see."""
        t = self._get(name)
        self.state.auth.check(self.role, t.name, "SELECT", t.owner)
        if t.kind == "view":
            return self.query(t.query)
        df = self._stored(t)
        policy = self.state.auth.row_filter(self.role, t.name, "SELECT", t.owner)
        return df if policy is None else df.filter(expression(policy))

    def _stored(self, t: Table, rid: bool = False) -> DataFrame:
        """A table with its partitions and the tables that inherit from it."""
        df = t.df if RID in t.df.columns else t.df.withColumn(RID, F.expr("uuid()")) if rid else t.df
        df = df if rid else df.drop(RID)
        for child in [c for c in self.state.tables.values() if c.parent == t.name]:
            df = df.unionByName(self._stored(child, rid).select(*df.columns)) if df is not None else self._stored(child, rid)
        return df

    # queries

    def query(self, sql: str) -> DataFrame:
        """A SELECT, VALUES or WITH."""
        tokens = self._names(flat(sql))
        plain = self._sequences(" ".join(t.text for t in tokens))
        joined = self._memberships(plain)
        run = lambda sql: self.spark.sql(rewrite(self._enum_order(self._recursive(sql))))
        try:
            df = run(joined)
        except AnalysisException:  # such as elements that make no array
            if joined == plain:
                raise
            df = run(plain)
        self.state.auth.check_columns(self.role, {t.text.lower() for t in tokens if t.kind == "word"}, df, self.state.tables)
        return df

    def _names(self, tokens: list[Token]) -> list[Token]:
        """Registers the relations that the tokens name as views, and makes schema-qualified names plain."""
        out: list[Token] = []
        for t in tokens:
            out.append(t)
            if len(out) >= 3 and out[-2].text == "." and out[-3].kind == "word":
                head, full = out[-3].text.lower(), f"{out[-3].text}.{t.text}".lower()
                if full in _CATALOGS or head in self.state.schemas or head == "pg_catalog":
                    plain = full.replace(".", "_") if full in _CATALOGS else t.text if head in ("public", "pg_catalog") else f"{head}__{t.text}"
                    out[-3:] = [Token("word", plain)]
        for name in {t.text.lower().strip('"') for t in out if t.kind in ("word", "quoted")}:
            if self._known(name):
                self.table(name).createOrReplaceTempView(name)
            elif name.replace("information_schema_", "information_schema.") in _CATALOGS:
                self._catalog(name.replace("information_schema_", "")).createOrReplaceTempView(name)
        return out

    def _enum_order(self, sql: str) -> str:
        """Columns of an enum sort and compare with constants by the order of its labels, not by their letters."""
        if not self.state.enums:
            return sql
        tokens = flat(sql)
        words = {t.text.lower() for t in tokens if t.kind == "word"}
        kinds = {c.name: self.state.enums[c.declared] for t in self.state.tables.values() if t.name in words for c in t.columns if c.declared in self.state.enums}
        place = lambda labels, x: f"array_position(ARRAY[{', '.join(quote(v) for v in labels)}], {x})"
        out, ordering, k = [], False, 0
        while k < len(tokens):
            t = tokens[k]
            if t.word("BY"):
                ordering = tokens[k - 1].word("ORDER")
            elif t.word("LIMIT", "OFFSET", "ROWS", "RANGE", "UNION", "FETCH") or t.text in ")":
                ordering = False
            name = t.text.lower()
            plain = t.kind == "word" and name in kinds and not (k + 1 < len(tokens) and tokens[k + 1].text in (".", "("))
            if plain:
                lead = out.pop() + out.pop() if len(out) >= 2 and out[-1] == "." else ""
                x = f"{lead[1:]}.{t.text}" if lead else t.text
                compared = k + 2 < len(tokens) and tokens[k + 1].text in ("<", "<=", ">", ">=") and tokens[k + 2].kind == "string"
                if compared:
                    out += [place(kinds[name], x), tokens[k + 1].text, place(kinds[name], tokens[k + 2].text)]
                    k += 3
                    continue
                out.append(place(kinds[name], x) if ordering else x)
            else:
                out.append(t.text)
            k += 1
        return " ".join(out)

    def _sequences(self, sql: str) -> str:
        """nextval, currval and setval become numbers, settings become texts, in the order of their places."""
        def value(m: re.Match) -> str:
            f, args = m[1].lower(), [literal(t) if t.kind == "string" else t.text for t in flat(m[2]) if t.kind in ("string", "number", "word")]
            if f == "current_setting":
                return quote(self.settings.get(args[0].lower(), ""))
            if f == "set_config":
                self.settings[args[0].lower()] = args[1]
                return quote(args[1])
            seq = self.state.sequences.setdefault(args[0], [1, 1, 0])
            if f == "setval":
                seq[0], seq[2] = int(args[1]) + seq[1], int(args[1])
            elif f == "nextval":
                seq[0], seq[2] = seq[0] + seq[1], seq[0]
            return str(seq[2])

        return re.sub(r"(?i)\b(nextval|currval|setval|current_setting|set_config)\s*\(([^()]*)\)", value, sql) if re.search(r"(?i)nextval|currval|setval|current_setting|set_config", sql) else sql

    def _memberships(self, sql: str) -> str:
        """Joins on x IN (e, f) as equal joins; the names of sql are views by now."""
        tokens = parse(sql)
        if not any(t.word("IN") for t in _deep(tokens)):
            return sql
        before = _text(tokens)
        after = _text(equal_joins(tokens, lambda name: [c.lower() for c in self.spark.table(name).columns] if name in self.state.tables else None))
        return sql if after == before else after

    def _recursive(self, sql: str) -> str:
        """WITH RECURSIVE ... UNION without ALL is run level by level; its rows become a view."""
        if not re.match(r"(?i)\s*WITH\s+RECURSIVE\b", sql):
            return sql
        tokens, i = parse(sql), 2
        kept: list[str] = []
        while True:
            name, columns = tokens[i].text, None
            i += 1
            if tokens[i].kind == "(":
                columns, i = [t.text for t in tokens[i].inside if t.kind == "word"], i + 1
            body, i = tokens[i + 1], i + 2  # AS (...)
            at = next((k for k, t in enumerate(body.inside) if t.word("UNION") and not body.inside[k + 1].word("ALL")), -1)
            own = any(t.word(name.upper()) for t in _deep(body.inside))
            if at >= 0 and own:
                start = self.query(_text(body.inside[:at]))
                start, step = start.toDF(*columns) if columns else start, _text(body.inside[at + 1 :])

                def again(new: DataFrame, name=name, step=step) -> DataFrame:
                    new.createOrReplaceTempView(name)
                    return self.spark.sql(rewrite(step))

                fixpoint(start, again).createOrReplaceTempView(name)
            else:
                kept.append(f"{name}{f' ({', '.join(columns)})' if columns else ''} AS ({_text(body.inside)})")
            if not (i < len(tokens) and tokens[i].op(",")):
                break
            i += 1
        rest = _text(tokens[i:])
        return f"WITH RECURSIVE {', '.join(kept)} {rest}" if kept else rest

    def _catalog(self, name: str) -> DataFrame:
        for lazy in self.state.lazy:
            self._known(lazy)
        tables, rows = self.state.tables.values(), []
        if name == "tables":
            rows, ddl = [("public", t.name, "VIEW" if t.kind == "view" else "BASE TABLE") for t in tables], "table_schema string, table_name string, table_type string"
        elif name == "columns":
            rows = [("public", t.name, c.name, i + 1, c.type, "NO" if c.not_null else "YES", c.default) for t in tables for i, c in enumerate(t.columns)]
            ddl = "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string"
        elif name == "schemata":
            rows, ddl = [(s, "admin") for s in sorted(self.state.schemas)], "schema_name string, schema_owner string"
        elif name == "pg_tables":
            rows, ddl = [("public", t.name, t.owner) for t in tables if t.kind != "view"], "schemaname string, tablename string, tableowner string"
        elif name == "pg_views":
            rows, ddl = [("public", t.name, t.owner, t.query) for t in tables if t.kind == "view"], "schemaname string, viewname string, viewowner string, definition string"
        elif name == "pg_roles":
            rows, ddl = [(r.name, r.superuser, r.login) for r in self.state.auth.roles.values()], "rolname string, rolsuper boolean, rolcanlogin boolean"
        elif name == "pg_namespace":
            rows, ddl = [(s,) for s in sorted(self.state.schemas)], "nspname string"
        elif name == "pg_stat_user_tables":
            rows, ddl = [("public", t.name) for t in tables if t.kind != "view"], "schemaname string, relname string"
        elif name == "pg_stat_statements":
            rows, ddl = [(q, n) for q, (n,) in self.statistics.items()], "query string, calls long"
        else:
            ddl = "schemaname string, tablename string, indexname string, indexdef string"
        return self.spark.createDataFrame(rows, ddl)

    # statements

    def sql(self, text: str) -> DataFrame | Result:
        """One statement: a DataFrame of a query, a Result of anything else."""
        text = text.strip().rstrip(";").strip()
        tokens = flat(text)
        if not tokens:
            return Result("")
        head = tokens[0].text.upper()
        if self.failed and head not in ("ROLLBACK", "COMMIT", "END", "ABORT"):
            raise EngineError("the transaction is aborted; statements are ignored until ROLLBACK")
        try:
            self.statistics.setdefault(text, [0])[0] += 1
            if head in ("SELECT", "VALUES", "TABLE") or head == "WITH":
                if head == "TABLE":
                    return self.query(f"SELECT * FROM {tokens[1].text}")
                into = self._select_into(text)
                return into if into is not None else self.query(text)
            if _NO_OPS.match(text):
                return Result(" ".join(t.text.upper() for t in tokens[:2]))
            do = getattr(self, f"_do_{head.lower()}", None)
            if do is None:
                raise DialectError(f"unknown statement {head}")
            return do(text, tokens)
        except Exception:
            self.failed = bool(self.saved)
            raise

    def python_function(self, name: str, f: Callable, returns: str) -> None:
        """A Python function under a name of SQL; its arguments and results travel in Arrow batches."""
        self.spark.udf.register(name, F.udf(f, returns, useArrow=True))

    def script(self, text: str) -> list[DataFrame | Result]:
        return [self.sql(s) for s in statements(text)]

    def load_dump(self, text: str) -> list[Result]:
        """A dump's statements and COPY blocks; what only a server has (SET, OWNER, no-ops) passes."""
        return [self.copy_from_data(sql, lines) if lines is not None else self.sql(sql) for sql, lines in dump.parts(text)]

    def _select_into(self, text: str) -> Result | None:
        tokens = parse(text)
        at = next((k for k, t in enumerate(tokens) if t.word("INTO")), -1)
        if at < 0 or not tokens[0].word("SELECT"):
            return None
        return self._create_as(tokens[at + 1].text, _text([*tokens[:at], *tokens[at + 2 :]]), True)

    # transactions

    def _do_begin(self, text, tokens) -> Result:
        self.saved.append(("", self.state.saved()))
        return Result("BEGIN")

    _do_start = _do_begin

    def _do_commit(self, text, tokens) -> Result:
        if self.failed:
            return self._do_rollback(text, tokens[:1])
        self.saved = []
        return Result("COMMIT")

    _do_end = _do_commit

    def _do_savepoint(self, text, tokens) -> Result:
        if not self.saved:
            raise EngineError("SAVEPOINT needs a transaction")
        self.saved.append((tokens[1].text.lower(), self.state.saved()))
        return Result("SAVEPOINT")

    def _do_release(self, text, tokens) -> Result:
        name = tokens[-1].text.lower()
        at = max((k for k, (n, _) in enumerate(self.saved) if n == name), default=-1)
        if at < 0:
            raise EngineError(f"savepoint {name} does not exist")
        del self.saved[at:]
        return Result("RELEASE")

    def _do_rollback(self, text, tokens) -> Result:
        if any(t.word("TO") for t in tokens):
            name = tokens[-1].text.lower()
            at = max((k for k, (n, _) in enumerate(self.saved) if n == name), default=-1)
            if at < 0:
                raise EngineError(f"savepoint {name} does not exist")
            self.state = self.saved[at][1].saved()
            del self.saved[at + 1 :]
        elif self.saved:
            self.state, self.saved = self.saved[0][1], []
        self.failed = False
        return Result("ROLLBACK")

    _do_abort = _do_rollback

    # settings, prepared statements, cursors

    def _do_set(self, text, tokens) -> Result:
        words = [t for t in tokens[1:] if not t.word("LOCAL", "SESSION", "TO") and t.text != "="]
        if words[0].word("ROLE") or words[0].word("AUTHORIZATION"):
            name = words[1].text.strip("'\"").lower()
            self.role = "admin" if name in ("none", "default") else self.state.auth.known(name)
        elif not words[0].word("TRANSACTION", "CONSTRAINTS"):
            self.settings[words[0].text.lower()] = ", ".join(literal(t) if t.kind == "string" else t.text for t in words[1:] if t.text != ",")
        return Result("SET")

    def _do_reset(self, text, tokens) -> Result:
        if tokens[1].word("ROLE"):
            self.role = "admin"
        self.settings.pop(tokens[1].text.lower(), None)
        return Result("RESET")

    def _do_show(self, text, tokens) -> DataFrame:
        name = tokens[1].text.lower()
        return self.spark.createDataFrame([(self.settings.get(name, ""),)], f"`{name}` string")

    def _do_prepare(self, text, tokens) -> Result:
        m = re.match(r"(?is)PREPARE\s+(\w+)\s*(\([^)]*\))?\s*AS\s+(.*)", text)
        self.prepared[m[1].lower()] = m[3]
        return Result("PREPARE")

    def _do_execute(self, text, tokens):
        name = tokens[1].text.lower()
        if name not in self.prepared:
            raise EngineError(f"prepared statement {name} does not exist")
        group = next((t for t in parse(text) if t.kind == "("), None)
        args = [_text(a) for a in split(group.inside)] if group else []
        sql = " ".join(args[int(t.text[1:]) - 1] if t.kind == "param" and t.text[0] == "$" else t.text for t in flat(self.prepared[name]))
        return self.sql(sql)

    def _do_deallocate(self, text, tokens) -> Result:
        self.prepared.clear() if tokens[-1].word("ALL") else self.prepared.pop(tokens[-1].text.lower(), None)
        return Result("DEALLOCATE")

    def _do_declare(self, text, tokens) -> Result:
        m = re.match(r"(?is)DECLARE\s+(\w+)\s+.*?\bFOR\s+(.*)", text)
        self.cursors[m[1].lower()] = self.query(m[2]).toLocalIterator()
        return Result("DECLARE CURSOR")

    def _fetch(self, tokens) -> list[Row]:
        name = tokens[-1].text.lower()
        if name not in self.cursors:
            raise EngineError(f"cursor {name} does not exist")
        words = [t for t in tokens[1:-1] if not t.word("FROM", "IN", "FORWARD", "NEXT")]
        if words and words[0].word("ALL"):
            return list(self.cursors[name])
        n = int(words[0].text) if words and words[0].kind == "number" else 1
        return [r for _, r in zip(range(n), self.cursors[name])]  # noqa: B905

    def _do_fetch(self, text, tokens) -> list[Row]:
        return self._fetch(tokens)

    def _do_move(self, text, tokens) -> Result:
        return Result("MOVE", len(self._fetch(tokens)))

    def _do_close(self, text, tokens) -> Result:
        self.cursors.clear() if tokens[-1].word("ALL") else self.cursors.pop(tokens[-1].text.lower(), None)
        return Result("CLOSE CURSOR")

    def _do_explain(self, text, tokens) -> DataFrame:
        own = re.sub(r"(?is)^EXPLAIN\s+(ANALYZE\s+|VERBOSE\s+|\([^)]*\)\s*)*", "", text)
        df = self.query(own)
        if any(t.word("ANALYZE") for t in tokens[:3]):
            df.write.format("noop").mode("overwrite").save()
        plan = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self.spark.createDataFrame([(x,) for x in plan.split("\n")], "plan string")

    # COPY

    def _copy_parts(self, text: str):
        m = re.match(r"(?is)COPY\s+(\(.*\)|[\w.\"]+\s*(?:\([^)]*\))?)\s+(TO|FROM)\s+(STDOUT|STDIN|'(?:[^']|'')*')\s*(?:WITH)?\s*(.*)$", text)
        if not m:
            raise DialectError("a COPY of another shape")
        own, tokens = {}, parse(m[4])
        if tokens and tokens[0].kind == "(":
            pairs = [(p[0].text.lower(), p[1:] if len(p) > 1 else []) for p in split(tokens[0].inside)]
        else:
            pairs = [(t.text.lower(), tokens[k + 1 : k + 2]) for k, t in enumerate(tokens) if t.kind == "word"]
        for name, value in pairs:
            v = value[0] if value else None
            value = literal(v) if v is not None and v.kind == "string" else v.text.lower() if v is not None else ""
            if name == "csv":
                own["format"] = "csv"
            elif name == "header":
                own["header"] = value not in ("false", "off", "0")
            elif name in ("format", "delimiter", "null", "quote", "escape"):
                own[name] = value.encode().decode("unicode_escape") if name == "delimiter" else value
        return m[1], m[2].upper(), m[3], copy.CopyOptions(**own)

    def _do_copy(self, text, tokens) -> Result:
        what, way, where, options = self._copy_parts(text)
        if way == "TO":
            df = self.query(what[1:-1]) if what.startswith("(") else self._copy_source(what)
            if where.upper() == "STDOUT":
                lines = copy.lines(df, options)
                if options.header:
                    lines = self.spark.createDataFrame([(options.sep.join(df.columns),)], "line string").unionByName(lines)
                return Result("COPY", lines=lines)
            copy.write(df, literal(Token("string", where)), options)
            return Result("COPY")
        name, columns = self._copy_target(what)
        return self._insert(name, copy.read(self.spark, literal(Token("string", where)), self._part(name, columns), options), columns, "COPY")

    def copy_from_data(self, sql: str, lines: list[str]) -> Result:
        """COPY ... FROM STDIN with the lines that the client sent."""
        what, _, _, options = self._copy_parts(sql)
        name, columns = self._copy_target(what)
        return self._insert(name, copy.read_lines(self.spark, lines, self._part(name, columns), options), columns, "COPY")

    def _copy_target(self, what: str) -> tuple[str, list[str]]:
        m = re.match(r"([\w.\"]+)\s*(?:\(([^)]*)\))?", what)
        name = self._plain(m[1])
        return name, [c.strip().strip('"') for c in m[2].split(",")] if m[2] else [c.name for c in self._get(name).columns]

    def _copy_source(self, what: str) -> DataFrame:
        name, columns = self._copy_target(what)
        return self.table(name).select(*columns)

    def _part(self, name: str, columns: list[str]) -> T.StructType:
        kinds = {f.name.lower(): f for f in self._get(name).schema()}
        return T.StructType([kinds[c.lower()] for c in columns])

    def _plain(self, name: str) -> str:
        name = name.strip('"').lower()
        head, _, rest = name.partition(".")
        return name if not rest else rest if head == "public" else f"{head}__{rest}"


from .ddl import Definitions  # noqa: E402
from .dml import Changes  # noqa: E402


def _deep(tokens: list[Token]) -> Iterator[Token]:
    for t in tokens:
        yield t
        yield from _deep(t.inside)


def _text(tokens: list[Token]) -> str:
    """The dialect's SQL of a token tree, not yet rewritten."""
    return " ".join({"(": f"({_text(t.inside)})", "[": f"[{_text(t.inside)}]"}.get(t.kind, t.text) for t in tokens)


for _part in (Definitions, Changes):
    for _name, _value in vars(_part).items():
        if not _name.startswith("__"):
            setattr(Engine, _name, _value)
