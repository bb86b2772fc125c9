"""Set operations, windows and nulls against plain Python on generated rows."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from talus.engine import Engine

ROWS = st.lists(st.tuples(st.none() | st.integers(0, 3), st.none() | st.integers(0, 2)), max_size=7)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@pytest.fixture(scope="module")
def db(spark):
    return Engine(spark)


def put(db, **tables):
    for name, rows in tables.items():
        db.register(name, db.spark.createDataFrame(rows, "a int, b int"))


def got(db, sql):
    return Counter(tuple(r) for r in db.sql(sql).collect())


@SLOW
@given(ROWS, ROWS)
def test_set_operations(db, x, y):
    put(db, x=x, y=y)
    cx, cy = Counter(x), Counter(y)
    assert got(db, "SELECT a, b FROM x UNION ALL SELECT a, b FROM y") == cx + cy
    assert got(db, "SELECT a, b FROM x INTERSECT ALL SELECT a, b FROM y") == cx & cy
    assert got(db, "SELECT a, b FROM x EXCEPT ALL SELECT a, b FROM y") == cx - cy
    assert got(db, "SELECT a, b FROM x EXCEPT SELECT a, b FROM y") == Counter(set(x) - set(y))


@SLOW
@given(ROWS)
def test_running_sum_by_groups(db, x):
    put(db, x=x)
    want = Counter()
    for a, b in x:
        key = lambda v: (v is None, v or 0)
        own = [q for p, q in x if p == a and key(q) <= key(b) and q is not None]
        want[(a, b, sum(own) if own else None)] += 1
    assert got(db, "SELECT a, b, CAST(sum(b) OVER (PARTITION BY a ORDER BY b) AS INT) AS s FROM x") == want


@SLOW
@given(ROWS, ROWS)
def test_null_aware_not_in_and_joins(db, x, y):
    put(db, x=x, y=y)
    values = [b for _, b in y]
    want = Counter(r for r in x if not values or (r[1] is not None and None not in values and r[1] not in values))
    assert got(db, "SELECT a, b FROM x WHERE b NOT IN (SELECT b FROM y)") == want
    full = Counter((p, q) for p, _ in x for q, _ in y if p is not None and p == q)
    full += Counter((p, None) for p, _ in x if p is None or p not in [q for q, _ in y])
    full += Counter((None, q) for q, _ in y if q is None or q not in [p for p, _ in x])
    assert got(db, "SELECT x.a, y.a AS c FROM x FULL JOIN y ON x.a = y.a") == full
