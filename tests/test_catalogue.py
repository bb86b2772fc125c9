"""Every query of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from talus import catalogue
from talus.session import TABLES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(D), reason="no test data")
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, float):
        return repr(round(v, 7) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return f"[{','.join(map(cell, v))}]"
    return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted("|".join(map(cell, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, D).toArrow())
    if name in ORACLE:
        assert got == rows(duck.sql(ORACLE[name]).to_arrow_table())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
