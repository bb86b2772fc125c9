"""Math functions."""

from __future__ import annotations

from . import macro


@macro("trunc", "truncate")
def trunc(x, n=None):
    return f"(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END)" if n is None else f"((CASE WHEN {x} < 0 THEN ceil({x} * pow(10, {n})) ELSE floor({x} * pow(10, {n})) END) / pow(10, {n}))"


@macro("log")
def log(b, x=None):
    """Of base 10, or of base b."""
    return f"log10({b})" if x is None else f"log({b}, {x})"


@macro("random")
def random():
    return "rand()"


@macro("sqrt")
def sqrt(x):
    """Of a negative number an error."""
    return f"CASE WHEN {x} < 0 THEN raise_error('square root of a negative number') ELSE sqrt({x}) END"


@macro("ln")
def ln(x):
    """Of zero or less an error."""
    return f"CASE WHEN {x} <= 0 THEN raise_error('logarithm of zero or less') ELSE ln({x}) END"


@macro("div")
def div(a, b):
    return f"({a} div {b})"
