"""Queries of the catalogue that once ran on part of their table."""

import re

import pyarrow.parquet as pq
from talus import catalogue

D = "/root/testdata/sf0.001"


def test_cast_matrix_casts_all_prices(spark):
    got = {r.p_partkey: r.d for r in catalogue.queries()["cast_matrix"](spark, D).collect()}
    assert got == {r["p_partkey"]: int(r["p_retailprice"]) for r in pq.read_table(f"{D}/part.parquet").to_pylist()}


def test_join_range_joins_all_parts(spark):
    got = sorted((r.event_id, r.p_partkey) for r in catalogue.queries()["join_range"](spark, D).collect())
    parts, events = (pq.read_table(f"{D}/{t}.parquet").to_pylist() for t in ("part", "events"))
    assert got == sorted((e["event_id"], p["p_partkey"]) for e in events for p in parts if p["p_size"] <= e["value"] < p["p_size"] + 2)


def test_string_functions_read_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{D}/documents.parquet").to_pylist()}
    vowels = str.maketrans("aeiou", "12345")
    whole = {
        "lower": str.lower, "replace": lambda t: t.replace("e", "<E>"), "reverse": lambda t: t[::-1], "translate": lambda t: t.translate(vowels),
        "regexp_replace": lambda t: re.sub("([a-z])e", r"[\1]", t, count=1), "regexp_replace_all": lambda t: re.sub("[eE]", "_", t),
    }
    for name, f in whole.items():
        got = {r.doc_id: r.x for r in catalogue.queries()[f"fn_string_{name}"](spark, D).collect()}
        assert got == {i: f(t) for i, t in texts.items()}, name
