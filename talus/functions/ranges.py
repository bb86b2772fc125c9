"""Ranges as text, "[low,high)"."""

from __future__ import annotations

from . import macro, text_of


@macro("int4range", "int8range", "numrange", "tsrange", "daterange")
def make_range(low, high, bounds="'[)'"):
    b = text_of(bounds)
    return f"CASE WHEN {low} = {high} AND '{b}' <> '[]' THEN 'empty' ELSE concat('{b[0]}', coalesce(CAST({low} AS STRING), ''), ',', coalesce(CAST({high} AS STRING), ''), '{b[1]}') END"


@macro("lower_range", "range_lower")
def lower_range(x):
    return f"nullif(regexp_extract({x}, '^[\\\\[(]([^,]*),', 1), '')"


@macro("upper_range", "range_upper")
def upper_range(x):
    return f"nullif(regexp_extract({x}, ',([^\\\\])]*)[\\\\])]$', 1), '')"


@macro("isempty")
def isempty(x):
    return f"({x} IN ('empty', ''))"


@macro("range_contains")
def range_contains(x, v):
    """Of numbers."""
    low, high = f"CAST({lower_range(x)} AS DOUBLE)", f"CAST({upper_range(x)} AS DOUBLE)"
    return f"(NOT {isempty(x)} AND coalesce(CASE WHEN left({x}, 1) = '[' THEN {v} >= {low} ELSE {v} > {low} END, true) AND coalesce(CASE WHEN right({x}, 1) = ']' THEN {v} <= {high} ELSE {v} < {high} END, true))"
