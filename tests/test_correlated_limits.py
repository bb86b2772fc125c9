"""Correlated subqueries with ORDER BY and LIMIT whose sort keys aren't columns of the result."""

import pyarrow.parquet as pq
import pytest
from talus import catalogue
from talus.dialect.rewrite import rewrite
from talus.engine import Engine

D = "/root/testdata/sf0.001"
TOP = "SELECT c_custkey, t.* FROM customer, LATERAL (SELECT {} FROM orders WHERE o_custkey = c_custkey ORDER BY {} LIMIT 2) AS t"


def windows(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in line and "Window" in line]


@pytest.mark.parametrize("columns, by", [("o_orderkey", "o_totalprice DESC, o_orderkey"), ("o_orderkey", "-o_totalprice, 1"), ("o_orderkey AS o_totalprice", "orders.o_totalprice DESC, o_totalprice"), ("orders.*", "o_totalprice DESC, o_orderkey")])
def test_lateral_rows_are_ordered_in_their_window(spark, columns, by):
    df = Engine(spark, D).sql(TOP.format(columns, by))
    assert windows(df) and all("ASC NULLS" in w or "DESC NULLS" in w for w in windows(df)), windows(df)  # a window without an order takes rows as a shuffle brings them
    key = "o_totalprice" if " AS " in columns else "o_orderkey"
    orders = sorted(pq.read_table(f"{D}/orders.parquet").to_pylist(), key=lambda o: (o["o_custkey"], -o["o_totalprice"], o["o_orderkey"]))
    want = [(o["o_custkey"], o["o_orderkey"]) for k, o in enumerate(orders) if k < 2 or orders[k - 2]["o_custkey"] != o["o_custkey"]]
    assert sorted((r["c_custkey"], r[key]) for r in df.collect()) == sorted(want)


def test_join_lateral_topk_is_ordered(spark):
    assert all("DESC NULLS" in w for w in windows(catalogue.queries()["join_lateral_topk"](spark, D)))


def test_scalar_subquery_with_limit(spark):
    df = Engine(spark, D).sql("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k FROM customer")
    best = {}
    for o in pq.read_table(f"{D}/orders.parquet").to_pylist():
        best[o["o_custkey"]] = max(best.get(o["o_custkey"], (-1, 0)), (o["o_totalprice"], -o["o_orderkey"]))
    assert df.columns == ["c_custkey", "k"] and {r.c_custkey: r.k for r in df.collect() if r.k is not None} == {c: -k for c, (_, k) in best.items()}
    assert all("DESC NULLS" in w for w in windows(df))


def test_limits_without_hidden_keys_stay():
    for sql in ("SELECT a FROM (SELECT DISTINCT a FROM t ORDER BY a LIMIT 3) AS s", "SELECT a FROM (SELECT a FROM t LIMIT 3) AS s", "SELECT a FROM (SELECT b + 1 AS a FROM t ORDER BY a LIMIT 3) AS s"):
        assert "__sort" not in rewrite(sql)
