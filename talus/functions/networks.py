"""Network addresses as text."""

from __future__ import annotations

from . import macro


@macro("host")
def host(x):
    return f"split_part({x}, '/', 1)"


@macro("family")
def family(x):
    return f"CASE WHEN instr({x}, ':') > 0 THEN 6 WHEN {x} IS NOT NULL THEN 4 END"


@macro("masklen")
def masklen(x):
    return f"CASE WHEN instr({x}, '/') > 0 THEN CAST(split_part({x}, '/', 2) AS INT) ELSE CASE {family(x)} WHEN 6 THEN 128 WHEN 4 THEN 32 END END"


def _number(x: str) -> str:
    return "(" + " + ".join(f"shiftleft(CAST(split_part({host(x)}, '.', {i + 1}) AS BIGINT), {24 - 8 * i})" for i in range(4)) + ")"


def _address(n: str) -> str:
    return "concat_ws('.', " + ", ".join(f"CAST(shiftright({n}, {24 - 8 * i}) & 255 AS STRING)" for i in range(4)) + ")"


@macro("network")
def network(x):
    """The address with the bits of the host cleared, and the mask; of version 4."""
    return f"concat({_address(f'({_number(x)} & shiftleft(shiftright(4294967295L, 32 - {masklen(x)}), 32 - {masklen(x)}))')}, '/', {masklen(x)})"


@macro("broadcast")
def broadcast(x):
    return f"concat({_address(f'({_number(x)} | (shiftleft(1L, 32 - {masklen(x)}) - 1))')}, '/', {masklen(x)})"
