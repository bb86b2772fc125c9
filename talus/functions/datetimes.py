"""Date, time and interval functions. Timestamps are without a zone; intervals are kept as months and microseconds where they are results."""

from __future__ import annotations

from ..dialect import patterns
from ..dialect.tokens import quote
from . import macro, text_of

#: Fields whose Spark expression differs; @ is the argument.
_FIELDS = {
    "dow": "CAST(extract(DOW FROM @) - 1 AS DOUBLE)", "isodow": "CAST(weekday(@) + 1 AS DOUBLE)", "epoch": "unix_micros(CAST(@ AS TIMESTAMP_LTZ)) / 1000000.0D", "milliseconds": "CAST(extract(SECOND FROM @) * 1000 AS DOUBLE)",
    "microseconds": "CAST(extract(SECOND FROM @) * 1000000 AS DOUBLE)", "second": "CAST(extract(SECOND FROM @) AS DOUBLE)",
}


@macro("extract", "date_part")
def extract(field, x):
    """The field is a name or a constant; the result is a double."""
    name = (text_of(field) if field[:1] == "'" else field).lower()
    return f"({_FIELDS[name].replace('@', x)})" if name in _FIELDS else f"CAST(extract({name} FROM {x}) AS DOUBLE)"


@macro("now", "current_timestamp")
def now():
    return "current_timestamp()"


@macro("current_date")
def current_date():
    return "current_date()"


def _months(a: str, b: str) -> str:
    """Whole months from b to a, towards zero."""
    return f"CAST(months_between(date_trunc('DAY', {a}), date_trunc('DAY', {b})) AS INT)"


@macro("age_months")
def age_months(a, b="current_date()"):
    return _months(a, b)


@macro("age_days")
def age_days(a, b="current_date()"):
    return f"datediff({a}, add_months(CAST({b} AS DATE), {_months(a, b)}))"


@macro("age")
def age(a, b=None):
    """Years, months and days from b to a as text; the time of day is dropped."""
    a, b = ("current_date()", a) if b is None else (a, b)
    m, d = _months(a, b), age_days(a, b)
    part = lambda n, unit: f"CASE WHEN {n} <> 0 THEN concat(CAST({n} AS STRING), ' {unit}', CASE WHEN abs({n}) = 1 THEN '' ELSE 's' END) END"
    return f"coalesce(nullif(concat_ws(' ', {part(f'({m} div 12)', 'year')}, {part(f'({m} % 12)', 'mon')}, {part(f'({d})', 'day')}), ''), CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN '00:00:00' END)"


@macro("to_date")
def to_date(s, fmt=None):
    return f"CAST({s} AS DATE)" if fmt is None else f"to_date({s}, {quote(patterns.date_format(text_of(fmt)))})"


@macro("to_timestamp")
def to_timestamp(s, fmt=None):
    """Of seconds since 1970, or of a text with its format."""
    return f"CAST(timestamp_micros(CAST({s} * 1000000 AS BIGINT)) AS TIMESTAMP_NTZ)" if fmt is None else f"to_timestamp_ntz({s}, {quote(patterns.date_format(text_of(fmt)))})"


@macro("parse_timestamp")
def parse_timestamp(s):
    """A timestamp's text in any of the usual layouts; null if in none."""
    layouts = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd"]
    return f"coalesce({', '.join([f'try_cast({s} AS TIMESTAMP_NTZ)', *(f'CAST(try_to_timestamp({s}, {quote(x)}) AS TIMESTAMP_NTZ)' for x in layouts)])})"


@macro("interval_text")
def interval_text(months, micros):
    """Years, months, days and time of an interval that is kept as months and microseconds."""
    unit = lambda n, one, more: f"CASE WHEN {n} <> 0 THEN concat(CAST({n} AS STRING), ' ', CASE WHEN {n} = 1 THEN '{one}' ELSE '{more}' END) END"
    day, left = f"({micros} div 86400000000)", f"({micros} % 86400000000)"
    clock = f"CASE WHEN {left} <> 0 THEN concat(CASE WHEN {left} < 0 THEN '-' ELSE '' END, lpad(abs({left}) div 3600000000, 2, '0'), ':', lpad(abs({left}) div 60000000 % 60, 2, '0'), ':', lpad(abs({left}) div 1000000 % 60, 2, '0')) END"
    return f"coalesce(nullif(concat_ws(' ', {unit(f'({months} div 12)', 'year', 'years')}, {unit(f'({months} % 12)', 'mon', 'mons')}, {unit(day, 'day', 'days')}, {clock}), ''), '00:00:00')"
