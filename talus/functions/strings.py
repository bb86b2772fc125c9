"""String and formatting functions."""

from __future__ import annotations

import re

from ..dialect import patterns
from ..dialect.tokens import quote
from . import macro, text_of


@macro("concat")
def concat(*xs):
    return f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in xs)})"


@macro("ltrim")
def ltrim(s, chars=None):
    return f"ltrim({s})" if chars is None else f"TRIM(LEADING {chars} FROM {s})"


@macro("rtrim")
def rtrim(s, chars=None):
    return f"rtrim({s})" if chars is None else f"TRIM(TRAILING {chars} FROM {s})"


@macro("btrim")
def btrim(s, chars=None):
    return f"btrim({s})" if chars is None else f"TRIM(BOTH {chars} FROM {s})"


@macro("strpos")
def strpos(s, sub):
    return f"instr({s}, {sub})"


@macro("regexp_replace")
def regexp_replace(s, pattern, new, flags="''"):
    """The first match alone, unless the flags have g."""
    own = text_of(flags)
    p = ("(?i)" if "i" in own else "") + text_of(pattern)
    r = patterns.replacement(text_of(new))
    if "g" in own:
        return f"regexp_replace({s}, {quote(p)}, {quote(r)})"
    shift = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", r)
    return f"regexp_replace({s}, {quote(f'(?s)^(.*?)({p})')}, {quote('$1' + shift)})"


@macro("regexp_match")
def regexp_match(s, pattern, flags="''"):
    """The first group, or the match where there is none; null without a match."""
    p = ("(?i)" if "i" in text_of(flags) else "") + text_of(pattern)
    group = 1 if re.compile(p).groups else 0
    return f"CASE WHEN {s} RLIKE {quote(p)} THEN regexp_extract({s}, {quote(p)}, {group}) END"


@macro("starts_with")
def starts_with(s, prefix):
    return f"startswith({s}, {prefix})"


@macro("num_nulls")
def num_nulls(*xs):
    return f"({' + '.join(f'CAST({x} IS NULL AS INT)' for x in xs)})"


@macro("num_nonnulls")
def num_nonnulls(*xs):
    return f"({' + '.join(f'CAST({x} IS NOT NULL AS INT)' for x in xs)})"


@macro("gen_random_uuid")
def gen_random_uuid():
    return "uuid()"


@macro("encode")
def encode(x, kind):
    return {"hex": f"lower(hex({x}))", "base64": f"base64(CAST({x} AS BINARY))", "escape": f"CAST({x} AS STRING)"}[text_of(kind)]


@macro("decode")
def decode(x, kind):
    return {"hex": f"unhex({x})", "base64": f"unbase64({x})", "escape": f"CAST({x} AS BINARY)"}[text_of(kind)]


@macro("format")
def format_(fmt, *xs):
    """%s, %I (an identifier), %L (a literal) and %%."""
    parts, rest = [], [*xs]
    for piece in re.split(r"(%[sIL%])", text_of(fmt)):
        if piece == "%s":
            parts.append(f"coalesce(CAST({rest.pop(0)} AS STRING), '')")
        elif piece == "%I":
            x = rest.pop(0)
            parts.append(f"CASE WHEN CAST({x} AS STRING) RLIKE '^[a-z_][a-z0-9_]*$' THEN CAST({x} AS STRING) ELSE concat('\"', replace(CAST({x} AS STRING), '\"', '\"\"'), '\"') END")
        elif piece == "%L":
            x = rest.pop(0)
            parts.append(f"coalesce(concat('\\'', replace(CAST({x} AS STRING), '\\'', '\\'\\''), '\\''), 'NULL')")
        elif piece:
            parts.append(quote("%" if piece == "%%" else piece))
    return f"concat({', '.join(parts or [quote('')])})"


@macro("to_char")
def to_char(x, fmt):
    text = text_of(fmt)
    if re.search(r"[90]", text) and not re.search(r"[YMDH]", text):
        decimals, grouped = patterns.number_format(text)
        return f"format_number({x}, {decimals})" if grouped else f"CAST(CAST({x} AS DECIMAL(38, {decimals})) AS STRING)"
    return f"date_format({x}, {quote(patterns.date_format(text))})"


@macro("to_number")
def to_number(x, fmt=None):
    return f"CAST(regexp_replace({x}, '[,$ ]', '') AS DECIMAL(38, 10))"


@macro("string_to_array")
def string_to_array(s, delimiter, null=None):
    parts = f"split({s}, {quote(re.escape(text_of(delimiter)))}, -1)"
    return parts if null is None else f"transform({parts}, x -> nullif(x, {null}))"


@macro("array_to_string")
def array_to_string(a, delimiter, null=None):
    return f"array_join({a}, {delimiter}{f', {null}' if null else ''})"


@macro("quote_literal")
def quote_literal(x):
    return f"concat('\\'', replace(CAST({x} AS STRING), '\\'', '\\'\\''), '\\'')"
