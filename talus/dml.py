"""Statements that change data. They are methods of the engine."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import engine as e


#: Rows of an insert whose serial numbers have no gaps.
SERIAL_ROWS = 100_000


def _at(tokens, *words, start=0):
    return next((k for k in range(start, len(tokens)) if tokens[k].word(*words)), len(tokens))


class Changes:
    # inserts

    def _do_insert(self, text, tokens):
        tree = e.parse(text)
        name, k, alias = self._plain(tree[2].text), 3, None
        while k + 1 < len(tree) and tree[k].op("."):
            name, k = self._plain(f"{tree[2].text}.{tree[4].text}"), k + 2
        t = self._get(name)
        if tree[k].word("AS"):
            alias, k = tree[k + 1].text, k + 2
        columns = [c.name for c in t.columns if c.generated is None]
        if tree[k].kind == "(" and not e.is_query(tree[k].inside):
            columns, k = [p[0].text.strip('"').lower() for p in e.split(tree[k].inside)], k + 1
        stop = min(_at(tree, "RETURNING", start=k), next((i for i in range(k, len(tree) - 1) if tree[i].word("ON") and tree[i + 1].word("CONFLICT")), len(tree)))
        body = tree[k:stop]
        if body[0].word("DEFAULT"):
            columns, source = [], self.spark.range(1).select()
        else:
            if body[0].word("VALUES"):
                by = {c.name: c for c in t.columns}
                rows = [[self._default(t, by[columns[i]]) if len(v) == 1 and v[0].word("DEFAULT") else e._text(v) for i, v in enumerate(e.split(g.inside))] for g in body if g.kind == "("]
                columns = columns[: len(rows[0])]
                source = self.query("VALUES " + ", ".join(f"({', '.join(r)})" for r in rows))
            else:
                source = self.query(e._text(body))
                columns = columns[: len(source.columns)]
        conflict = tree[stop:] if stop < len(tree) and tree[stop].word("ON") else []
        returning = tree[_at(tree, "RETURNING", start=stop) + 1 :]
        for rule in t.rules:
            if rule[1] == "INSERT":
                if not rule[2]:
                    self._insert(name, source, columns, "INSERT")
                return self.sql(rule[3]) if not rule[3].upper().startswith("NOTHING") else e.Result("INSERT")
        return self._insert(name, source, columns, "INSERT", conflict[: _at(conflict, "RETURNING")], e._text(returning), alias)

    def _default(self, t, c) -> str:
        if c.default == "__serial":
            seq = self.state.sequences.setdefault(f"{t.name}_{c.name}_seq", [1, 1, 0])
            seq[0], seq[2] = seq[0] + 1, seq[0]
            return str(seq[2])
        return c.default or "NULL"

    def _fill(self, t, source: DataFrame, columns: list[str]) -> DataFrame:
        """All columns of t, cast, with defaults and generated values, and a new row id."""
        source = source.toDF(*columns)
        given, out = {c.lower() for c in columns}, []
        for c in t.columns:
            if c.name in given and c.generated is None:
                x = F.col(f"`{c.name}`")
            elif c.default == "__serial":
                seq = self.state.sequences.setdefault(f"{t.name}_{c.name}_seq", [1, 1, 0])
                n = source.count()
                if n <= SERIAL_ROWS:  # without gaps, by one task; a larger insert gets ids with gaps, task by task
                    source = source.coalesce(1)
                x = F.lit(seq[0]) + F.monotonically_increasing_id()
                seq[0] += n if n <= SERIAL_ROWS else source.rdd.getNumPartitions() << 33
            else:
                x = F.expr(e.expression(self._sequences(c.default))) if c.default else F.lit(None)
            out.append(x.cast(c.type).alias(c.name))
        df = source.select(*out)
        for c in t.columns:
            if c.generated is not None:
                df = df.withColumn(c.name, F.expr(e.expression(c.generated)).cast(c.type))
        return df.select(*[c.name for c in t.columns]).withColumn(e.RID, F.expr("uuid()"))

    def _insert(self, name, source, columns, message, conflict=(), returning="", alias=None):
        t = self._get(name)
        self.state.auth.check(self.role, name, "INSERT", t.owner)
        new = self._fire(t, "BEFORE INSERT", self._fill(t, source, columns))
        new = e.written(new, f"{name}-new")
        self._checked(t, new, "INSERT")
        if conflict:
            return self._upsert(t, new, list(conflict), returning)
        if t.kind == "partitioned":
            self._route(t, new)
        else:
            self._validate(t, new)
            old = self._rids(t)
            self._unique(t, old, new)
            self.state.tables[name] = replace(t, df=self._version(t, old.unionByName(new)))
        count = new.count()
        self._fire(t, "AFTER INSERT", new)
        return e.Result(message, count, self._returning(t, new, returning))

    def _checked(self, t, new: DataFrame, command: str) -> None:
        """Raises if a new row breaks the policies of t."""
        check = self.state.auth.row_filter(self.role, t.name, command, t.owner, check=True)
        if check is not None and new.filter(f"NOT coalesce({e.expression(check)}, false)").limit(1).count():
            raise e.ConstraintError(f"a new row breaks a policy of {t.name}")

    def _version(self, t, df: DataFrame) -> DataFrame:
        if e.RID not in df.columns:
            df = df.withColumn(e.RID, F.expr("uuid()"))
        return e.written(df.select(*[c.name for c in t.columns], e.RID), t.name)

    def _rids(self, t) -> DataFrame:
        """The stored rows with ids that stay; a registered DataFrame gets its first version here."""
        if e.RID not in t.df.columns:
            t = replace(t, df=e.written(t.df.withColumn(e.RID, F.expr("uuid()")), t.name))
            self.state.tables[t.name] = t
        return t.df

    def _returning(self, t, rows: DataFrame, returning: str) -> DataFrame | None:
        if not returning:
            return None
        rows.drop(e.RID).createOrReplaceTempView("__returned")
        return self.spark.sql(e.rewrite(f"SELECT {returning} FROM __returned AS {t.name}"))

    def _upsert(self, t, new, conflict, returning):
        before, touched = dict(self.state.tables), new.limit(0)
        try:  # rows that conflict lie in the same partition, as its keys hold the partition's
            for own, rows in self._dealt(t, new) if t.kind == "partitioned" else [(t, new)]:
                touched = touched.unionByName(self._merge(own, rows, conflict, t))
        except Exception:
            self.state.tables = before
            raise
        return e.Result("INSERT", touched.count(), self._returning(t, touched, returning))

    def _merge(self, t, new, conflict, named) -> DataFrame:
        """The rows that t, which is the relation named or a partition of it, gets or changes."""
        target = conflict[2].kind == "("
        keys = [p[0].text.lower() for p in e.split(conflict[2].inside)] if target else list(named.keys[0])
        at = _at(conflict, "DO")
        old, on = self._rids(t), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
        if conflict[at + 1].word("NOTHING"):
            fresh = new
            for key in [keys] if target else named.keys:  # a null conflicts with nothing
                whole = F.lit(True)
                for k in key:
                    whole = whole & F.col(k).isNotNull()
                fresh = fresh.filter(~whole).unionByName(fresh.filter(whole).dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti").select(*new.columns))
            fresh = e.written(fresh, f"{t.name}-fresh")
            self._validate(t, fresh)
            self._unique(named, old, fresh)
            self.state.tables[t.name] = replace(self._get(t.name), df=self._version(t, old.unionByName(fresh)))
            self._fire(named, "AFTER INSERT", fresh)
            return fresh
        if new.dropna(subset=keys).groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise e.EngineError("ON CONFLICT DO UPDATE would change a row twice")
        where = _at(conflict, "WHERE", start=at)
        sets = self._assignments(conflict[at + 3 : where])
        names = [c.name for c in t.columns]
        old.alias("o").join(new.alias("n"), on).select(F.col(f"o.{e.RID}").alias(e.RID), *[F.col(f"o.{c}").alias(c) for c in names], *[F.col(f"n.{c}").alias(f"excluded__{c}") for c in names]).createOrReplaceTempView("__conflict")
        fix = lambda x: re.sub(rf"(?i)\b{named.name}\s*\.\s*(\w+)", r"\1", re.sub(r"(?i)\bexcluded\s*\.\s*(\w+)", lambda m: f"excluded__{m[1].lower()}", x))
        cond = fix(e._text(conflict[where + 1 :])) if where < len(conflict) else "true"
        cols = ", ".join(f"CAST({fix(sets[c])} AS {k}) AS {c}" if c in sets else c for c, k in ((c.name, c.type) for c in t.columns))
        changed = e.written(self.spark.sql(e.rewrite(f"SELECT {cols}, {e.RID} FROM __conflict WHERE {cond}")), f"{t.name}-changed")
        if t.name != named.name and changed.filter(f"NOT coalesce(({dict((c.name, x) for c, x in self._parts(named))[t.name]}), false)").limit(1).count():
            raise e.ConstraintError(f"ON CONFLICT may not move a row out of {t.name}")
        fresh = e.written(new.join(old.select(*keys), keys, "left_anti").select(*changed.columns), f"{t.name}-fresh")
        touched = changed.unionByName(fresh)
        self._validate(t, touched)
        kept = old.join(changed.select(e.RID), e.RID, "left_anti")
        self._unique(named, kept, touched)
        self.state.tables[t.name] = replace(self._get(t.name), df=self._version(t, kept.unionByName(touched)))
        self._fire(named, "AFTER INSERT", fresh)
        self._fire(named, "AFTER UPDATE", changed)
        return touched

    # partitions

    def _bound(self, child, keys) -> str:
        """The condition of a partition's rows."""
        tree = e.parse(child.bound)
        if any(x.word("DEFAULT") for x in tree):
            return ""
        groups = [x.inside for x in tree if x.kind == "("]
        if any(x.word("IN") for x in tree):
            values = [e._text(v) for v in e.split(groups[0])]
            known = ", ".join(v for v in values if v.upper() != "NULL")
            return " OR ".join([*([f"coalesce({keys[0]} IN ({known}), false)"] if known else []), *([f"{keys[0]} IS NULL"] if len(known) < len(", ".join(values)) else [])])
        if any(x.word("MODULUS") for x in tree):
            m, r = (int(x.text) for x in groups[0] if x.kind == "number")
            return f"pmod(xxhash64({', '.join(keys)}), {m}) = {r}"
        low, high = ([e._text(v) for v in e.split(g)] for g in groups[:2])
        return " AND ".join([self._beside(keys, low, ">"), self._beside(keys, high, "<"), *(f"{k} IS NOT NULL" for k in keys)])

    def _beside(self, keys, values, op: str) -> str:
        """Keys at or above values (>), or below them (<), compared one key after another."""
        terms, equal = [], []
        for k, v in zip(keys, values, strict=True):
            if v.upper() in ("MINVALUE", "MAXVALUE"):
                if (v.upper() == "MINVALUE") == (op == ">"):
                    terms.append(" AND ".join(equal) or "true")
                break
            terms.append(" AND ".join([*equal, f"{k} {op} {v}"]))
            equal.append(f"{k} = {v}")
        else:
            terms += [" AND ".join(equal)] if op == ">" else []
        return f"({' OR '.join(terms) or 'false'})"

    def _parts(self, t) -> list:
        """The partitions of t, each with the condition of its rows."""
        children = [c for c in self.state.tables.values() if c.parent == t.name]
        known = {c.name: e.expression(b) for c in children if (b := self._bound(c, t.part_keys))}
        rest = " AND ".join(f"NOT coalesce(({b}), false)" for b in known.values()) or "true"
        return [(c, known.get(c.name, rest)) for c in children]

    def _dealt(self, t, new) -> list:
        """The partitions of t that get rows of new, each with its rows."""
        dealt = [(c, new.filter(cond)) for c, cond in self._parts(t)]
        counts = [own.count() for _, own in dealt]
        if sum(counts) != new.count():
            raise e.ConstraintError(f"a row fits no partition of {t.name}")
        return [x for x, n in zip(dealt, counts, strict=True) if n]

    def _route(self, t, new) -> None:
        """New rows go to their partitions, if all may."""
        dealt = self._dealt(t, new)
        self._unique(t, self._stored(t), new)
        for c, own in dealt:
            self._validate(c, own)
            self._unique(c, self._rids(c), own)
        for c, own in dealt:
            c = self._get(c.name)
            self.state.tables[c.name] = replace(c, df=self._version(c, c.df.unionByName(own)))

    # updates and deletes

    def _assignments(self, tokens) -> dict[str, str]:
        out = {}
        for part in e.split(tokens):
            if part[0].kind == "(":
                values = e.split(part[2].inside)
                out |= {n[0].text.lower(): e._text(v) for n, v in zip(e.split(part[0].inside), values, strict=True)}
            else:
                at = next(k for k, x in enumerate(part) if x.op("="))
                out[part[at - 1].text.strip('"').lower()] = e._text(part[at + 1 :])
        return out

    def _matched(self, t, alias, select, sources, where, command, named) -> DataFrame:
        """The rows that a condition finds, once each, with their ids, of those that the policies of the relation named let the command see."""
        rows = self._rids(t)
        policy = self.state.auth.row_filter(self.role, named.name, command, named.owner)
        (rows.filter(e.expression(policy)) if policy is not None else rows).createOrReplaceTempView("__target")
        self._names(e.flat(f"{sources} {where} {select}"))
        sql = f"SELECT {alias}.{e.RID} AS {e.RID}, {select} FROM __target AS {alias}{f', {sources}' if sources else ''}{f' WHERE {where}' if where else ''}"
        return e.written(self.spark.sql(e.rewrite(self._sequences(sql))).dropDuplicates([e.RID]), f"{t.name}-matched")

    def _target(self, tree, k):
        name, k = self._plain(tree[k].text), k + 1
        alias = name
        if k < len(tree) and tree[k].word("AS"):
            alias, k = tree[k + 1].text, k + 2
        elif k < len(tree) and tree[k].kind == "word" and not tree[k].word("SET", "WHERE", "USING", "RETURNING"):
            alias, k = tree[k].text, k + 1
        return self._get(name), alias, k

    def _do_update(self, text, tokens):
        tree = e.parse(text)
        t, alias, k = self._target(tree, 1)
        self.state.auth.check(self.role, t.name, "UPDATE", t.owner)
        frm, where, ret = _at(tree, "FROM", start=k), _at(tree, "WHERE", start=k), _at(tree, "RETURNING", start=k)
        sets = self._assignments(tree[k + 1 : min(frm, where, ret)])
        sources = e._text(tree[frm + 1 : min(where, ret)]) if frm < len(tree) else ""
        names = {c.name: c for c in t.columns}
        total, touched = 0, None
        before, moved = dict(self.state.tables), None
        bounds = {c.name: x for c, x in self._parts(t)} if t.kind == "partitioned" else {}
        for own in [t, *(c for c in self.state.tables.values() if c.parent == t.name)]:
            select = ", ".join(f"CAST({self._default(t, c) if sets[n].upper() == 'DEFAULT' else sets[n]} AS {c.type}) AS {n}" if n in sets else f"{alias}.{n} AS {n}" for n, c in names.items() if c.generated is None)
            changed = self._matched(own, alias, select, sources, e._text(tree[where + 1 : ret]) if where < len(tree) else "", "UPDATE", t)
            for c in t.columns:
                if c.generated is not None:
                    changed = changed.withColumn(c.name, F.expr(e.expression(c.generated)).cast(c.type))
            changed = e.written(self._fire(t, "BEFORE UPDATE", changed.select(*names, e.RID)), f"{t.name}-changed")
            self._checked(t, changed, "UPDATE")
            kept = self._rids(self._get(own.name)).join(changed.select(e.RID), e.RID, "left_anti")
            self._validate(t, changed)
            self._unique(t, kept, changed)
            self._referenced(t, sets, own, changed)
            stays = changed
            if own.name in bounds:
                leaves = f"NOT coalesce(({bounds[own.name]}), false)"
                stays, gone = changed.filter(f"NOT ({leaves})"), changed.filter(leaves)
                moved = gone if moved is None else moved.unionByName(gone)
            self.state.tables[own.name] = replace(self._get(own.name), df=self._version(own, kept.select(*names, e.RID).unionByName(stays)))
            total += changed.count()
            touched = changed if touched is None else touched.unionByName(changed)
        if moved is not None and moved.limit(1).count():
            try:
                self._route(t, moved)
            except Exception:
                self.state.tables = before
                raise
        self._fire(t, "AFTER UPDATE", touched)
        return e.Result("UPDATE", total, self._returning(t, touched, e._text(tree[ret + 1 :])))

    def _do_delete(self, text, tokens):
        tree = e.parse(text)
        t, alias, k = self._target(tree, 2)
        self.state.auth.check(self.role, t.name, "DELETE", t.owner)
        using, where, ret = _at(tree, "USING", start=k), _at(tree, "WHERE", start=k), _at(tree, "RETURNING", start=k)
        sources = e._text(tree[using + 1 : min(where, ret)]) if using < len(tree) else ""
        total, touched = 0, None
        for own in [t, *(c for c in self.state.tables.values() if c.parent == t.name)]:
            gone = self._matched(own, alias, ", ".join(f"{alias}.{c.name} AS {c.name}" for c in t.columns), sources, e._text(tree[where + 1 : ret]) if where < len(tree) else "", "DELETE", t)
            gone = self._fire(t, "BEFORE DELETE", gone)
            total += self._remove(self._get(own.name), gone)
            touched = gone if touched is None else touched.unionByName(gone)
        self._fire(t, "AFTER DELETE", touched)
        return e.Result("DELETE", total, self._returning(t, touched, e._text(tree[ret + 1 :])))

    def _remove(self, t, gone) -> int:
        """Takes rows out of t and does what foreign keys to them ask for."""
        n = gone.count()
        if not n:
            return 0
        kept = self._rids(t).join(gone.select(e.RID), e.RID, "left_anti")
        for other in list(self.state.tables.values()):
            for fk in other.foreign:
                if fk.table != t.name:
                    continue
                left = gone.select(*fk.references).join(kept.select(*fk.references), list(fk.references), "left_anti").distinct()
                hit = self._rids(other).join(left.toDF(*fk.columns), list(fk.columns), "left_semi")
                if not hit.limit(1).count():
                    continue
                if fk.on_delete == "CASCADE":
                    self._remove(self._get(other.name), e.written(hit, "cascade"))
                elif fk.on_delete.startswith("SET"):
                    now = self._get(other.name)
                    ids = e.written(hit.select(e.RID), "cascade")
                    value = {c.name: F.expr(c.default if fk.on_delete == "SET DEFAULT" and c.default else "NULL").cast(c.type) for c in now.columns if c.name in fk.columns}
                    self.state.tables[now.name] = replace(now, df=self._version(now, now.df.join(ids, e.RID, "left_anti").unionByName(now.df.join(ids, e.RID, "left_semi").withColumns(value).select(*now.df.columns))))
                else:
                    raise e.ConstraintError(f"{other.name} still refers to rows of {t.name}")
        self.state.tables[t.name] = replace(self._get(t.name), df=self._version(t, kept))
        return n

    def _do_truncate(self, text, tokens):
        for name in [x.text for x in tokens[1:] if x.kind in ("word", "quoted") and not x.word("TABLE", "ONLY", "CASCADE", "RESTRICT", "RESTART", "CONTINUE", "IDENTITY")]:
            t = self._get(self._plain(name))
            for own in [t, *(c for c in self.state.tables.values() if c.parent == t.name)]:
                self.state.tables[own.name] = replace(own, df=self._empty(own.columns))
        return e.Result("TRUNCATE")

    # constraints: queries for rows that break them, one for each kind

    def _validate(self, t, rows: DataFrame) -> None:
        tests = [(f"{c.name} is null", F.col(c.name).isNull()) for c in t.columns if c.not_null or any(c.name in k for k in t.keys[:1] if c.not_null)]
        tests += [(name, ~F.coalesce(F.expr(e.expression(check)), F.lit(True))) for name, check in t.checks]
        for c in t.columns:
            if c.declared in self.state.enums:
                tests.append((f"{c.name} is not of {c.declared}", ~F.coalesce(F.col(c.name).isin(*self.state.enums[c.declared]), F.lit(True))))
            if c.declared in self.state.domains:
                _, not_null, check = self.state.domains[c.declared]
                if not_null:
                    tests.append((f"{c.name} is null", F.col(c.name).isNull()))
                if check:
                    tests.append((f"{c.name} breaks {c.declared}", ~F.coalesce(F.expr(e.expression(re.sub(r"(?i)\bVALUE\b", c.name, check))), F.lit(True))))
        if tests:
            found = rows.agg(*[F.max(test.cast("int")).alias(f"t{k}") for k, (_, test) in enumerate(tests)]).first()
            broken = [name for k, (name, _) in enumerate(tests) if found[k]]
            if broken:
                raise e.ConstraintError(f"{t.name}: {', '.join(broken)}")
        for fk in t.foreign:
            mine = rows.select(*fk.columns).dropna().toDF(*fk.references)
            theirs = self._stored(self._get(fk.table)).select(*fk.references)
            if fk.table == t.name:
                theirs = theirs.unionByName(rows.select(*fk.references))
            if mine.join(theirs, list(fk.references), "left_anti").limit(1).count():
                raise e.ConstraintError(f"{t.name}: ({', '.join(fk.columns)}) is not in {fk.table}")

    def _unique(self, t, old: DataFrame, new: DataFrame) -> None:
        for key in t.keys:
            mine = new.select(*key).dropna()
            if mine.groupBy(*key).count().filter("count > 1").limit(1).count() or mine.join(old.select(*key), list(key), "left_semi").limit(1).count():
                raise e.ConstraintError(f"{t.name}: ({', '.join(key)}) is there already")

    def _referenced(self, t, sets, own, changed) -> None:
        """Keys that others refer to may not change under them."""
        for other in self.state.tables.values():
            for fk in other.foreign:
                if fk.table == t.name and set(fk.references) & set(sets):
                    was = self._get(own.name).df.join(changed.select(e.RID), e.RID, "left_semi").select(*fk.references)
                    lost = was.join(changed.select(*fk.references), list(fk.references), "left_anti")
                    if self._stored(other).join(lost.toDF(*fk.columns), list(fk.columns), "left_semi").limit(1).count():
                        raise e.ConstraintError(f"{other.name} still refers to rows of {t.name}")

    # triggers

    def trigger_function(self, name: str, f) -> None:
        """f(rows, event) runs on a statement's rows at once: before, the DataFrame it returns takes their place; after, it only sees them."""
        self.trigger_functions[name.lower()] = f

    def _fire(self, t, event: str, rows: DataFrame) -> DataFrame:
        when, what = event.split()
        for _, on, name, args in t.triggers:
            if on.startswith(when) and what in on:
                if name == "tsvector_update_trigger":
                    target, _, *sources = [x.strip().strip("'") for x in args.split(",")]
                    rows = rows.withColumn(target, F.expr(e.expression(f"to_tsvector(concat_ws(' ', {', '.join(sources)}))")))
                    continue
                if name not in self.trigger_functions:
                    raise e.EngineError(f"trigger function {name} is not registered")
                got = self.trigger_functions[name](rows, event)
                if when == "BEFORE" and got is not None:
                    rows = got.select(*rows.columns)
        return rows
