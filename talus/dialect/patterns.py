"""Patterns and formats of PostgreSQL, translated to those of Java."""

from __future__ import annotations

import re

_UNITS = {
    "year": ("months", 12), "yr": ("months", 12), "y": ("months", 12), "mon": ("months", 1), "month": ("months", 1), "decade": ("months", 120), "century": ("months", 1200), "week": ("days", 7), "w": ("days", 7),
    "day": ("days", 1), "d": ("days", 1), "hour": ("micros", 3_600_000_000), "hr": ("micros", 3_600_000_000), "h": ("micros", 3_600_000_000), "minute": ("micros", 60_000_000), "min": ("micros", 60_000_000), "m": ("micros", 60_000_000),
    "second": ("micros", 1_000_000), "sec": ("micros", 1_000_000), "s": ("micros", 1_000_000), "millisecond": ("micros", 1000), "microsecond": ("micros", 1),
}


def similar_to(pattern: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif inside:
            out.append(c)
            inside = c != "]"
        elif c == "[":
            out.append(c)
            inside = True
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in "()|*+?{}":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


def interval(text: str) -> tuple[int, int, int]:
    """Months, days and microseconds of an interval's text."""
    total = {"months": 0.0, "days": 0.0, "micros": 0.0}
    ago = -1 if re.search(r"\bago\s*$", text) else 1
    text = re.sub(r"\bago\s*$|@", "", text.strip().lower())
    for sign, h, m, s in re.findall(r"(-?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?", text):
        total["micros"] += (-1 if sign else 1) * (int(h) * 3600 + int(m) * 60 + float(s or 0)) * 1e6
    text = re.sub(r"-?\d+:\d{1,2}(:\d{1,2}(\.\d+)?)?", " ", text)
    rest = re.sub(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", lambda m: _add(total, float(m[1]), m[2]), text)
    if rest.strip():
        raise ValueError(f"interval {text!r}")
    return round(ago * total["months"]), round(ago * total["days"]), round(ago * total["micros"])


def _add(total: dict, n: float, unit: str) -> str:
    kind, times = _UNITS.get(unit) or _UNITS.get(unit.rstrip("s")) or (None, 0)
    if kind is None:
        raise ValueError(f"interval unit {unit!r}")
    n *= times
    if kind == "months":  # a part of a month is days, a part of a day is time
        total["months"] += int(n)
        n, kind = (n - int(n)) * 30, "days"
    if kind == "days":
        total["days"] += int(n)
        n, kind = (n - int(n)) * 86_400_000_000, "micros"
    total["micros"] += n
    return ""


def make_interval(text: str) -> str:
    months, days, micros = interval(text)
    return f"make_interval(0, {months}, 0, {days}, 0, 0, CAST({micros} AS DECIMAL(18, 0)) / 1000000)"


#: Template patterns and Java's.
_DATE = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "MM": "MM", "Month": "MMMM", "Mon": "MMM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS",
    "AM": "a", "PM": "a", "am": "a", "pm": "a", "Day": "EEEE", "Dy": "EEE", "Q": "q",
}
_DATE_TOKEN = re.compile("|".join(sorted(map(re.escape, _DATE), key=len, reverse=True)) + r"|[A-Za-z]+|.", re.S)


def date_format(fmt: str) -> str:
    return "".join(_DATE.get(t, f"'{t}'" if t.isalpha() else "''" if t == "'" else t) for t in _DATE_TOKEN.findall(fmt))


def number_format(fmt: str) -> tuple[int, bool]:
    """Decimals, and whether thousands are grouped."""
    whole, _, part = re.sub(r"[^0-9.,]", "", fmt).partition(".")
    return len(part), "," in whole


def replacement(text: str) -> str:
    """The replacement of a regular expression: \\1 and \\& become $1 and $0."""
    text = text.replace("$", "\\$")
    return re.sub(r"\\(\d|&)", lambda m: "$" + (m[1] if m[1] != "&" else "0"), text)
