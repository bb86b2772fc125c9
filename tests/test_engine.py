import pytest

from talus.engine import ConstraintError, Engine, EngineError
from talus.security import AccessError


@pytest.fixture()
def db(spark):
    return Engine(spark)


def rows(x):
    return sorted([tuple(r) for r in (x.collect() if hasattr(x, "collect") else x.df.collect())], key=str)


def test_tables_and_changes(db):
    db.script("CREATE TABLE t (id SERIAL PRIMARY KEY, name TEXT NOT NULL, n INT DEFAULT 5 CHECK (n > 0), twice INT GENERATED ALWAYS AS (n * 2) STORED)")
    assert db.sql("INSERT INTO t (name) VALUES ('a'), ('b')").count == 2
    r = db.sql("INSERT INTO t (name, n) VALUES ('it''s', 7) RETURNING id, twice AS d")
    assert rows(r) == [(3, 14)]
    assert rows(db.sql("SELECT id, name, n, twice FROM t")) == [(1, "a", 5, 10), (2, "b", 5, 10), (3, "it's", 7, 14)]
    assert db.sql("UPDATE t SET n = n + 1 WHERE name IN (SELECT 'a')").count == 1
    assert rows(db.sql("SELECT n, twice FROM t WHERE id = 1")) == [(6, 12)]
    for bad in ("INSERT INTO t (name, n) VALUES ('x', -1)", "INSERT INTO t (name) VALUES (NULL)", "INSERT INTO t (id, name) VALUES (1, 'x')"):
        with pytest.raises(ConstraintError):
            db.sql(bad)
    assert db.sql("DELETE FROM t WHERE id = 2 RETURNING name").count == 1
    assert rows(db.sql("SELECT count(*) FROM t")) == [(2,)]
    db.sql("TRUNCATE t")
    assert rows(db.sql("SELECT count(*) FROM t")) == [(0,)]


def test_upsert_and_update_from(db):
    db.script("CREATE TABLE k (id BIGINT PRIMARY KEY, v TEXT); INSERT INTO k VALUES (1, 'a'), (2, 'b'); CREATE TABLE s AS SELECT 2 AS id, 'z' AS w")
    assert db.sql("INSERT INTO k VALUES (1, 'x'), (3, 'c') ON CONFLICT (id) DO NOTHING").count == 1
    db.sql("INSERT INTO k VALUES (1, 'x'), (4, 'd') ON CONFLICT (id) DO UPDATE SET v = k.v || excluded.v WHERE k.v <> 'q'")
    db.sql("UPDATE k SET v = s.w FROM s WHERE k.id = s.id")
    assert rows(db.sql("SELECT id, v FROM k")) == [(1, "ax"), (2, "z"), (3, "c"), (4, "d")]
    with pytest.raises(EngineError):
        db.sql("INSERT INTO k VALUES (1, 'p'), (1, 'q') ON CONFLICT (id) DO UPDATE SET v = excluded.v")


def test_foreign_keys(db):
    db.script("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT, p INT REFERENCES p(id) ON DELETE CASCADE); CREATE TABLE d (p INT REFERENCES p(id)); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (10, 1), (11, NULL)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO c VALUES (12, 9)")
    db.sql("DELETE FROM p WHERE id = 1")
    assert rows(db.sql("SELECT id FROM c")) == [(11,)]
    db.sql("INSERT INTO d VALUES (2)")
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM p")


def test_transactions(db):
    db.script("CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT s; INSERT INTO t VALUES (2); ROLLBACK TO s; COMMIT")
    assert rows(db.sql("SELECT a FROM t")) == [(1,)]
    db.sql("BEGIN")
    db.sql("DELETE FROM t")
    with pytest.raises(Exception):
        db.sql("SELECT nothing FROM t")
    with pytest.raises(EngineError):
        db.sql("SELECT a FROM t")
    db.sql("ROLLBACK")
    assert rows(db.sql("SELECT a FROM t")) == [(1,)]


def test_views_partitions_inheritance(db):
    db.script("CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y'); CREATE VIEW v AS SELECT b, a * 10 AS t10 FROM t; CREATE MATERIALIZED VIEW m AS SELECT max(a) AS a FROM t; INSERT INTO t VALUES (3, 'z')")
    assert rows(db.sql("SELECT t10 FROM v")) == [(10,), (20,), (30,)]
    assert rows(db.sql("SELECT a FROM m")) == [(2,)]
    db.sql("REFRESH MATERIALIZED VIEW m")
    assert rows(db.sql("SELECT a FROM m")) == [(3,)]
    db.script("CREATE TABLE e (k INT, v TEXT) PARTITION BY RANGE (k); CREATE TABLE e1 PARTITION OF e FOR VALUES FROM (0) TO (10); CREATE TABLE e2 PARTITION OF e DEFAULT; INSERT INTO e VALUES (5, 'a'), (50, 'b')")
    assert rows(db.sql("SELECT v FROM e1")) == [("a",)] and rows(db.sql("SELECT v FROM e")) == [("a",), ("b",)]
    db.sql("UPDATE e SET v = v || '!' WHERE k = 50")
    assert rows(db.sql("SELECT v FROM e2")) == [("b!",)]
    db.script("CREATE TABLE q (x INT); CREATE TABLE r (y INT) INHERITS (q); INSERT INTO r (x, y) VALUES (1, 2); INSERT INTO q VALUES (7)")
    assert rows(db.sql("SELECT * FROM q")) == [(1,), (7,)]


def test_alter(db):
    db.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); ALTER TABLE t ADD COLUMN b TEXT DEFAULT 'q', ADD c INT; ALTER TABLE t RENAME COLUMN a TO z; ALTER TABLE t DROP COLUMN c; ALTER TABLE t ALTER COLUMN z TYPE BIGINT; ALTER TABLE t RENAME TO u")
    assert db.sql("SELECT * FROM u").dtypes == [("z", "bigint"), ("b", "string")]
    with pytest.raises(ConstraintError):
        db.sql("ALTER TABLE u ADD CONSTRAINT big CHECK (z > 5)")


def test_types(db):
    db.script("CREATE TYPE mood AS ENUM ('sad', 'ok'); ALTER TYPE mood ADD VALUE 'happy'; CREATE DOMAIN pos AS INT CHECK (VALUE > 0); CREATE TABLE t (m mood, p pos); INSERT INTO t VALUES ('happy', 1)")
    for bad in ("INSERT INTO t VALUES ('bad', 1)", "INSERT INTO t VALUES ('ok', 0)"):
        with pytest.raises(ConstraintError):
            db.sql(bad)
    db.sql("INSERT INTO t VALUES ('sad', 2), ('ok', 3)")
    assert [r.m for r in db.sql("SELECT m FROM t ORDER BY t.m DESC").collect()] == ["happy", "ok", "sad"]
    assert rows(db.sql("SELECT p FROM t WHERE m > 'sad'")) == [(1,), (3,)]


def test_python_functions(db):
    db.python_function("shout", lambda s: s.upper() + "!", "string")
    assert rows(db.sql("SELECT shout('a') AS v")) == [("A!",)]


def test_security(db):
    db.script("CREATE TABLE t (who TEXT, n INT); INSERT INTO t VALUES ('a', 1), ('b', 2); CREATE ROLE ann; CREATE ROLE team; GRANT team TO ann; SET ROLE ann")
    with pytest.raises(AccessError):
        db.sql("SELECT * FROM t")
    db.script("RESET ROLE; GRANT SELECT ON t TO team; ALTER TABLE t ENABLE ROW LEVEL SECURITY; SET ROLE ann")
    assert rows(db.sql("SELECT * FROM t")) == []
    db.script("RESET ROLE; CREATE POLICY p ON t FOR SELECT USING (who = 'a'); CREATE POLICY r ON t AS RESTRICTIVE USING (n < 9); SET ROLE ann")
    assert rows(db.sql("SELECT who FROM t")) == [("a",)]
    with pytest.raises(AccessError):
        db.sql("DELETE FROM t")
    db.script("RESET ROLE; REVOKE SELECT ON t FROM team; GRANT SELECT (n) ON t TO ann; SET ROLE ann")
    assert rows(db.sql("SELECT n FROM t")) == [(1,)]
    with pytest.raises(AccessError):
        db.sql("SELECT who FROM t")
    db.sql("RESET ROLE")


def test_copy(db, tmp_path):
    db.sql("CREATE TABLE t (a INT, b TEXT)")
    db.copy_from_data("COPY t FROM STDIN", ["1\tx\\ty", "2\t\\N", "\\."])
    assert rows(db.sql("SELECT * FROM t")) == [(1, "x\ty"), (2, None)]
    assert sorted(r[0] for r in db.sql("COPY t TO STDOUT").lines.collect()) == ["1\tx\\ty", "2\t\\N"]
    assert sorted(r[0] for r in db.sql("COPY (SELECT a, 'p,\"q' AS c FROM t) TO STDOUT WITH (FORMAT csv, HEADER true)").lines.collect()) == ['1,"p,""q"', '2,"p,""q"', "a,c"]
    db.sql(f"COPY t TO '{tmp_path}/out' WITH (FORMAT csv, HEADER)")
    db.script(f"CREATE TABLE u (a INT, b TEXT); COPY u FROM '{tmp_path}/out' WITH (FORMAT csv, HEADER)")
    assert rows(db.sql("SELECT * FROM u")) == [(1, "x\ty"), (2, None)]
    db.load_dump("-- a dump\nCREATE TABLE w (a INT);\nCOPY w (a) FROM stdin;\n4\n5\n\\.\nSELECT 1;\n")
    assert rows(db.sql("SELECT a FROM w")) == [(4,), (5,)]


def test_prepared_cursors_settings(db):
    db.sql("PREPARE q AS SELECT $1 + $2 AS s")
    assert rows(db.sql("EXECUTE q(2, 3)")) == [(5,)]
    db.sql("DECLARE c CURSOR FOR SELECT * FROM (VALUES (1), (2), (3)) AS v(x) ORDER BY x")
    assert [r.x for r in db.sql("FETCH 2 FROM c")] == [1, 2]
    assert db.sql("MOVE 1 FROM c").count == 1 and db.sql("FETCH NEXT FROM c") == []
    db.sql("SET work_mem = '4MB'")
    assert rows(db.sql("SHOW work_mem")) == [("4MB",)] and rows(db.sql("SELECT current_setting('work_mem') AS w")) == [("4MB",)]
    db.sql("CREATE SEQUENCE sq START 5")
    assert rows(db.sql("SELECT nextval('sq') AS a, nextval('sq') AS b, currval('sq') AS c")) == [(5, 6, 6)]
    assert any("Scan" in r[0] or "Project" in r[0] for r in db.sql("EXPLAIN SELECT 1 AS a").collect())
    assert "VACUUM" in db.sql("VACUUM ANALYZE").message


def test_functions_and_blocks(db):
    db.sql("CREATE FUNCTION add3(a INT, b INT) RETURNS INT AS $$ SELECT a + b + 3 $$ LANGUAGE sql")
    assert rows(db.sql("SELECT add3(1, 2) AS x")) == [(6,)]
    db.sql("CREATE FUNCTION fact(n INT) RETURNS INT AS $$ DECLARE r INT := 1; BEGIN FOR i IN 1..n LOOP r := r * i; END LOOP; IF r > 100 THEN RETURN -1; ELSE RETURN r; END IF; END $$ LANGUAGE plpgsql")
    assert db.call("fact", 4) == 24 and db.call("fact", 6) == -1
    db.script("CREATE TABLE t (a INT)")
    db.sql("DO $$ DECLARE i INT := 0; BEGIN WHILE i < 3 LOOP i := i + 1; CONTINUE WHEN i = 2; INSERT INTO t VALUES (i); END LOOP; BEGIN RAISE EXCEPTION 'no %', i; EXCEPTION WHEN OTHERS THEN INSERT INTO t VALUES (99); END; END $$")
    assert rows(db.sql("SELECT a FROM t")) == [(1,), (3,), (99,)]
    db.sql("CREATE AGGREGATE total(FLOAT8) (sfunc = float8pl, stype = float8, initcond = '0')")
    assert db.table("t").agg(db.aggregate("total", "a").alias("s")).first().s == 103.0


def test_triggers_and_rules(db):
    from pyspark.sql import functions as F

    seen = []
    db.trigger_function("up", lambda df, event: df.withColumn("b", F.upper("b")))
    db.trigger_function("log", lambda df, event: seen.append((event, df.count())))
    db.script("CREATE TABLE t (a INT, b TEXT); CREATE TRIGGER x BEFORE INSERT ON t FOR EACH ROW EXECUTE FUNCTION up(); CREATE TRIGGER y AFTER INSERT OR DELETE ON t FOR EACH STATEMENT EXECUTE FUNCTION log(); INSERT INTO t VALUES (1, 'q'); DELETE FROM t")
    assert seen == [("AFTER INSERT", 1), ("AFTER DELETE", 1)]
    db.script("CREATE TABLE l (n INT); CREATE RULE r AS ON INSERT TO t DO INSTEAD INSERT INTO l VALUES (1); INSERT INTO t VALUES (2, 'w')")
    assert rows(db.sql("SELECT * FROM l")) == [(1,)] and rows(db.sql("SELECT * FROM t")) == []


def test_catalogs_and_schemas(db):
    db.script("CREATE SCHEMA s; CREATE TABLE s.t (a INT NOT NULL); INSERT INTO s.t VALUES (1)")
    assert rows(db.sql("SELECT a FROM s.t")) == [(1,)]
    assert rows(db.sql("SELECT column_name, is_nullable FROM information_schema.columns")) == [("a", "NO")]
    assert rows(db.sql("SELECT tablename FROM pg_tables")) == [("s__t",)]


def test_recursion(db):
    db.script("CREATE TABLE g (a INT, b INT); INSERT INTO g VALUES (1, 2), (2, 3), (3, 1)")
    assert rows(db.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT b FROM g JOIN r ON g.a = r.n) SELECT n FROM r")) == [(1,), (2,), (3,)]
    assert rows(db.sql("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 300) SELECT count(*) AS k, max(n) AS m FROM c")) == [(300, 300)]


def test_policies_of_changes_and_serial_defaults(db):
    db.script("CREATE ROLE ann; CREATE TABLE p (id INT, o TEXT); INSERT INTO p VALUES (1, 'a'), (2, 'a'), (3, 'b'); GRANT SELECT, UPDATE, DELETE ON p TO ann; ALTER TABLE p ENABLE ROW LEVEL SECURITY")
    db.script("CREATE POLICY s ON p FOR SELECT USING (true); CREATE POLICY u ON p FOR UPDATE USING (true) WITH CHECK (o = 'a'); SET ROLE ann")
    assert db.sql("DELETE FROM p").count == 0
    with pytest.raises(ConstraintError):
        db.sql("UPDATE p SET o = 'b'")
    assert db.sql("UPDATE p SET o = 'a', id = id + 10 WHERE id = 3").count == 1
    db.script("RESET ROLE; CREATE POLICY d ON p FOR DELETE USING (id < 2); SET ROLE ann; DELETE FROM p; RESET ROLE")
    assert rows(db.sql("SELECT id, o FROM p")) == [(13, "a"), (2, "a")]
    db.script("CREATE TABLE q (id SERIAL, n INT); CREATE TABLE r (id SERIAL, n INT); INSERT INTO q (n) VALUES (1); INSERT INTO q VALUES (DEFAULT, 2); INSERT INTO r VALUES (DEFAULT, 3); INSERT INTO q (n) VALUES (4)")
    assert rows(db.sql("SELECT id, n FROM q")) == [(1, 1), (2, 2), (3, 4)]
    assert rows(db.sql("SELECT id, n FROM r")) == [(1, 3)]


def test_rows_of_partitioned_tables(db):
    db.script("CREATE TABLE e (k INT, j INT, v TEXT, PRIMARY KEY (k, j)) PARTITION BY RANGE (k, j); CREATE TABLE e1 PARTITION OF e FOR VALUES FROM (0, 0) TO (10, 5); CREATE TABLE e2 PARTITION OF e FOR VALUES FROM (10, 5) TO (MAXVALUE, MAXVALUE)")
    db.sql("INSERT INTO e VALUES (10, 4, 'a'), (10, 5, 'b'), (2, 90, 'c')")
    assert rows(db.sql("SELECT v FROM e1")) == [("a",), ("c",)] and rows(db.sql("SELECT v FROM e2")) == [("b",)]
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO e VALUES (10, 4, 'again')")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO e VALUES (-1, 0, 'nowhere')")
    assert db.sql("INSERT INTO e VALUES (2, 90, 'd'), (11, 0, 'e') ON CONFLICT (k, j) DO UPDATE SET v = e.v || excluded.v").count == 2
    assert rows(db.sql("SELECT v FROM e1")) == [("a",), ("cd",)] and rows(db.sql("SELECT v FROM e2")) == [("b",), ("e",)]
    assert db.sql("INSERT INTO e VALUES (2, 90, 'x') ON CONFLICT DO NOTHING").count == 0
    assert db.sql("UPDATE e SET k = 20 WHERE v = 'a'").count == 1
    assert rows(db.sql("SELECT v FROM e1")) == [("cd",)] and rows(db.sql("SELECT k, v FROM e2")) == [(10, "b"), (11, "e"), (20, "a")]
    with pytest.raises(ConstraintError):
        db.sql("UPDATE e SET k = -5 WHERE v = 'e'")
    assert rows(db.sql("SELECT v FROM e")) == [("a",), ("b",), ("cd",), ("e",)]


def test_upserts_keep_other_keys(db):
    db.script("CREATE TABLE u (a INT PRIMARY KEY, b INT UNIQUE); INSERT INTO u VALUES (1, 1), (2, 2)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO u VALUES (1, 9) ON CONFLICT (a) DO UPDATE SET b = 2")
    assert db.sql("INSERT INTO u VALUES (3, 2), (4, NULL), (5, NULL) ON CONFLICT DO NOTHING").count == 2
    assert rows(db.sql("SELECT a FROM u")) == [(1,), (2,), (4,), (5,)]
