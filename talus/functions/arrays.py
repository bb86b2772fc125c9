"""Array functions; places count from 1."""

from __future__ import annotations

from . import macro


@macro("array_length", "cardinality")
def array_length(a, dimension="1"):
    return f"size({a})"


@macro("unnest")
def unnest(a):
    return f"explode({a})"


@macro("array_cat")
def array_cat(a, b):
    return f"concat({a}, {b})"


@macro("array_at")
def array_at(a, i):
    """Null beyond either end."""
    if i.isdigit():
        return f"try_element_at({a}, {i})" if int(i) else "NULL"
    return f"CASE WHEN {i} >= 1 THEN try_element_at({a}, CASE WHEN {i} >= 1 THEN CAST({i} AS INT) ELSE 1 END) END"


@macro("array_slice")
def array_slice(a, low, high):
    """Both ends included, clamped to the array."""
    return f"slice({a}, greatest(CAST({low} AS INT), 1), greatest(CAST({high} AS INT) - greatest(CAST({low} AS INT), 1) + 1, 0))"


@macro("array_contains_all")
def array_contains_all(a, b):
    return f"(size(array_except({b}, {a})) = 0)"


@macro("array_overlap")
def array_overlap(a, b):
    return f"arrays_overlap({a}, {b})"
