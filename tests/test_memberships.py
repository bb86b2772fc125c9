"""Joins on x IN (e, f) as equal joins: the same rows as by comparing all pairs, which they don't."""

import pytest
from talus import catalogue
from talus.engine import Engine

D = "/root/testdata/sf0.001"
JOINS = [
    "SELECT a.i, b.j FROM a JOIN b ON x IN (y, z)",
    "SELECT a.i, b.j FROM a, b WHERE x IN (y, z + 0, y) AND a.i > 0",
    "SELECT a.i, b.j FROM a q JOIN b AS a ON q.x IN (a.y, a.z, 4)",
    "SELECT a.i, b.j FROM b JOIN a ON (a.x IN (b.z, CAST(b.y AS DOUBLE PRECISION))) AND x IN (z, 5)",
    "SELECT a.*, b.j FROM a CROSS JOIN b WHERE a.x IN (b.y::DOUBLE PRECISION, -b.z)",
    "SELECT * FROM b INNER JOIN a ON x IN (y)",
]
OTHERS = [
    "SELECT a.i, b.j FROM a LEFT JOIN b ON x IN (y, z)", "SELECT a.i, b.j FROM a JOIN b ON x NOT IN (y, z)", "SELECT a.i, b.j FROM a JOIN b ON x IN (y, a.i)",
    "SELECT a.i, b.j FROM a JOIN b ON x IN (y, z) OR a.i = b.j", "SELECT a.i FROM a WHERE x IN (SELECT y FROM b)",
]


@pytest.fixture
def db(spark):
    nan = float("nan")
    out = Engine(spark)
    out.register("a", spark.createDataFrame([(1, 0.0), (2, -0.0), (3, None), (4, 4.0), (5, nan), (6, 5.0), (0, 4.0)], "i int, x double"))
    out.register("b", spark.createDataFrame([(1, 0.0, -0.0), (2, None, 4.0), (3, 4.0, 4.0), (4, nan, nan), (5, 5.0, None), (6, None, None), (7, -4.0, 0.0), (7, -4.0, 0.0)], "j int, y double, z double"))
    return out


def key(row):
    return [repr(v) for v in row]


@pytest.mark.parametrize("sql", [*JOINS, *OTHERS])
def test_rows_of_all_pairs(db, sql):
    sql = sql.replace("SELECT a.i, b.j FROM a q", "SELECT q.i, a.j FROM a q")
    df = db.sql(sql)
    for name in "ab":
        db.table(name).createOrReplaceTempView(name)
    plain = db.spark.sql(sql.replace("::DOUBLE PRECISION", "").replace("DOUBLE PRECISION", "DOUBLE"))
    assert df.columns == plain.columns and sorted(map(key, df.collect())) == sorted(map(key, plain.collect()))
    assert ("__in0" in df._jdf.queryExecution().optimizedPlan().toString()) == (sql.count("LEFT") + sql.count("NOT") + sql.count("a.i)") + sql.count(" OR ") + sql.count("IN (SELECT") == 0)


def test_elements_of_several_kinds(db):
    assert sorted(r.i for r in db.sql("SELECT i FROM a JOIN b ON i IN (j, '7', z)").collect()) == sorted(r.i for r in db.spark.sql("SELECT i FROM a JOIN b ON i IN (j, '7', z)").collect())


def test_hierarchy_compares_no_pairs(spark):
    df = catalogue.queries()["cte_recursive_hierarchy"](spark, D)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "(p_partkey#" in plan and " = __in0#" in plan
    parts = set(range(1, 200)) & {r[0] for r in spark.read.parquet(f"{D}/part.parquet").select("p_partkey").collect()}
    assert sorted(map(tuple, df.collect())) == [(k, k.bit_length() - 1) for k in sorted(parts | {1})]


def test_recursion_of_more_than_a_million_rows(spark):
    sql = "WITH RECURSIVE t(d) AS (SELECT 0 UNION ALL SELECT d + b FROM t CROSS JOIN (VALUES (1), (1)) AS v(b) WHERE d < 20) SELECT count(*) AS n FROM t"
    assert Engine(spark, D).sql(sql).first().n == 2**21 - 1
