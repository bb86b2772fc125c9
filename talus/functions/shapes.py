"""Geometry as text: point (x,y), lseg [(x,y),(x,y)], box (x,y),(x,y), circle <(x,y),r>, polygon ((x,y),...), path open [...] or closed (...)."""

from __future__ import annotations

from . import macro

_NUMBER = "'-?[0-9]+(?:\\\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?'"


def _num(x: str) -> str:
    """A number as text, whole ones without a point."""
    return f"CASE WHEN CAST({x} AS DOUBLE) = floor(CAST({x} AS DOUBLE)) THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST(CAST({x} AS DOUBLE) AS STRING) END"


def _all(x: str) -> str:
    return f"transform(regexp_extract_all({x}, {_NUMBER}, 0), n -> CAST(n AS DOUBLE))"


def _at(x: str, i: int) -> str:
    return f"get({_all(x)}, {i})"


@macro("point")
def point(x, y):
    return f"concat('(', {_num(x)}, ',', {_num(y)}, ')')"


@macro("lseg")
def lseg(a, b):
    return f"concat('[', {a}, ',', {b}, ']')"


@macro("box")
def box(a, b):
    return f"concat({a}, ',', {b})"


@macro("circle")
def circle(center, radius):
    return f"concat('<', {center}, ',', {_num(radius)}, '>')"


@macro("polygon")
def polygon(*xs):
    return f"concat('(', concat_ws(',', {', '.join(xs)}), ')')" if len(xs) > 1 else f"CASE WHEN {xs[0]} LIKE '((%' THEN {xs[0]} ELSE concat('(', {xs[0]}, ')') END"


@macro("path")
def path(*xs):
    return f"concat('[', concat_ws(',', {', '.join(xs)}), ']')" if len(xs) > 1 else xs[0]


@macro("radius")
def radius(x):
    return _at(x, 2)


@macro("diameter")
def diameter(x):
    return f"(2 * {_at(x, 2)})"


@macro("width")
def width(x):
    return f"abs({_at(x, 0)} - {_at(x, 2)})"


@macro("height")
def height(x):
    return f"abs({_at(x, 1)} - {_at(x, 3)})"


@macro("area")
def area(x):
    """Of a circle, a box, or a polygon by the shoelace rule."""
    n = f"(size({_all(x)}) div 2)"
    ring = f"aggregate(sequence(0, {n} - 1), 0.0D, (s, i) -> s + get({_all(x)}, 2 * i) * get({_all(x)}, (2 * i + 3) % (2 * {n})) - get({_all(x)}, (2 * i + 2) % (2 * {n})) * get({_all(x)}, 2 * i + 1))"
    return f"CASE WHEN {x} LIKE '<%' THEN pi() * pow({_at(x, 2)}, 2) WHEN {x} LIKE '((%' THEN abs({ring}) / 2 ELSE {width(x)} * {height(x)} END"


@macro("center")
def center(x):
    return f"CASE WHEN {x} LIKE '<%' THEN {point(_at(x, 0), _at(x, 1))} ELSE {point(f'(({_at(x, 0)} + {_at(x, 2)}) / 2)', f'(({_at(x, 1)} + {_at(x, 3)}) / 2)')} END"


@macro("npoints")
def npoints(x):
    return f"(size({_all(x)}) div 2)"


@macro("isclosed")
def isclosed(x):
    return f"({x} LIKE '(%')"


@macro("isopen")
def isopen(x):
    return f"({x} LIKE '[%')"


@macro("pclose")
def pclose(x):
    return f"CASE WHEN {x} LIKE '[%' THEN concat('(', substring({x}, 2, length({x}) - 2), ')') ELSE {x} END"


@macro("popen")
def popen(x):
    return f"CASE WHEN {x} LIKE '(%' THEN concat('[', substring({x}, 2, length({x}) - 2), ']') ELSE {x} END"


@macro("bound_box")
def bound_box(a, b):
    side = lambda f, i: f"{f}({_at(a, i)}, {_at(a, i + 2)}, {_at(b, i)}, {_at(b, i + 2)})"
    return box(point(side("greatest", 0), side("greatest", 1)), point(side("least", 0), side("least", 1)))


@macro("geo_distance")
def geo_distance(a, b):
    """Between points, or the centres of circles and boxes."""
    c = lambda x, i: f"CASE WHEN size({_all(x)}) = 4 THEN ({_at(x, i)} + {_at(x, i + 2)}) / 2 ELSE {_at(x, i)} END"
    return f"sqrt(pow(({c(a, 0)}) - ({c(b, 0)}), 2) + pow(({c(a, 1)}) - ({c(b, 1)}), 2))"
