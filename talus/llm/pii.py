"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select them.

The base kinds (email, ip, card, phone) are exact patterns whose matches always stay. Further kinds have generators of high recall, whose spans may
overlap: secret (keys and tokens), national_id, local_phone (without a country code) and masked_email ("a (at) b (dot) c"). A span's features
are of its format (length, digits, letters, entropy, separators) and context (words and marks around it). Gradient-boosted trees of depth 2 are trained
on examples made from templates with a seed, TRAINING of them; their scores are calibrated on a quarter of the examples that is held out, by Platt's method, and each kind's
threshold is the least with PRECISION on another quarter. Of selected spans that overlap, the likeliest stays; none that overlaps a base span does.

Results that are defined here: a null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows are each searched. An
empty table gives an empty result. A column named like a new one is replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, table, tidy

BASE = ["email", "ip", "card", "phone"]
FURTHER = ["secret", "national_id", "local_phone", "masked_email"]
TRAINING = 4000
PRECISION = 0.99
SPANS = "array<struct<kind:string,start:long,stop:long,score:double>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # a number is tried from its first digit alone: the rest would fail alike
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![A-Za-z0-9_/+=-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "masked_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]++)+"),
}
#: What a match of a kind must have; a text without it is not searched for that kind.
_NEEDS = {"national_id": re.compile("[0-9]"), "local_phone": re.compile("[0-9]"), "masked_email": re.compile(r"[\[(] ?(?:at|AT)")}
_HINTS = {
    "secret": re.compile(r"(?i)token|secret|passw|api|key|auth|bearer|credential"), "national_id": re.compile(r"(?i)ssn|social|security|national|tax|\bid\b"),
    "local_phone": re.compile(r"(?i)call|phone|tel|mobile|cell|fax|dial|reach"), "masked_email": re.compile(r"(?i)mail|contact|write|reach"),
}
#: How keys of well-known services begin.
_SERVICES = ["sk_live_", "sk_test_", "pk_live_", "rk_live_", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AIza", "sk-"]
_OTHER = re.compile(r"(?i)commit|sha|checksum|order|invoice|version|isbn|part|model|serial|path|http|page|date|hash|ref")


def emails(text: str) -> list[tuple[int, int]]:
    """Like a search of the whole pattern, but from each @ outwards, which is linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(x)) > 9 else d for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and stop, by kind and then start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, p in _GENERATORS.items() if kind not in _NEEDS or _NEEDS[kind].search(text) for m in p.finditer(text)]


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    own, before, after = text[start:stop], text[max(0, start - 40) : start], text[stop : stop + 20]
    n, counts = len(own), Counter(own)
    share = lambda test: sum(map(test, own)) / n
    near = before.rstrip()[-1:]
    return [
        float(n), share(str.isdigit), share(str.isupper), share(lambda c: c in "0123456789abcdefABCDEF"), share(lambda c: not c.isalnum()),
        -sum(c / n * math.log2(c / n) for c in counts.values()), float(any(map(str.isdigit, own)) and any(map(str.isalpha, own))), float(own.isalpha()),
        float(bool(_HINTS[kind].search(before[-30:]))), float(bool(_OTHER.search(before[-24:]))), float(near in "=:"), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(after[:1])),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), float(before[-1:].isalnum()), sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:])) / n, float(own.startswith(tuple(_SERVICES))), float(FURTHER.index(kind)),  # noqa: B905
    ]


class Boosted:
    """Trees of depth 2 for the logistic loss, on features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, cuts: int = 24, ridge: float = 1.0):
        self.trees: list[tuple] = []
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        at = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, cuts))) for j in range(x.shape[1])]
        tests = [(j, c, x[:, j] > c) for j in range(x.shape[1]) for c in at[j]]
        matrix, f = np.array([t[2] for t in tests], np.float64), np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)

            def split(rows):
                gr, hr = matrix @ (g * rows), matrix @ (h * rows)
                gl, hl = (g * rows).sum() - gr, (h * rows).sum() - hr
                i = int((gr**2 / (hr + ridge) + gl**2 / (hl + ridge)).argmax())
                return i, gl[i] / (hl[i] + ridge), gr[i] / (hr[i] + ridge)

            root = split(np.ones(len(y)))[0]
            right = matrix[root]
            (a, a0, a1), (b, b0, b1) = split(1 - right), split(right)
            leaf = np.where(right > 0, np.where(matrix[b] > 0, b1, b0), np.where(matrix[a] > 0, a1, a0))
            f = f + rate * leaf
            self.trees.append((*tests[root][:2], *tests[a][:2], rate * a0, rate * a1, *tests[b][:2], rate * b0, rate * b1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for j, c, ja, ca, a0, a1, jb, cb, b0, b1 in self.trees:
            f += np.where(x[:, j] > c, np.where(x[:, jb] > cb, b1, b0), np.where(x[:, ja] > ca, a1, a0))
        return f


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and answers of spans that templates make: of each kind, personal data and what looks like it."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(k))
    word = lambda: "".join(rng.choice(["an", "the", "er", "ing", "st", "on", "re", "ou", "ch"]) for _ in range(rng.randint(1, 4)))
    some = lambda k: " ".join(word() for _ in range(rng.randint(1, k)))
    x, y = [], []
    while len(x) < n:
        kind, good = rng.choice(FURTHER), rng.random() < 0.5
        if kind == "secret":
            if good:
                own = rng.choice([hexes(32), hexes(40), hexes(64), hexes(rng.randint(16, 600)), mixed(rng.randint(20, 44)), mixed(rng.randint(45, 600)), re.sub("[^A-Za-z]", "x", mixed(rng.randint(20, 64)))])
                lead = rng.choice(["token", "api_key", "secret", "password", "auth", "access key", "client_secret", "TOKEN"]) + rng.choice([" = ", "=", ": ", ":"])
                quote = rng.choice(['"', '"', "'", ""])
                if rng.random() < 0.25:  # a key that a service's mark tells, whatever stands before it
                    own = rng.choice(_SERVICES) + rng.choice([mixed(rng.randint(16, 40)), mixed(rng.randint(16, 40)).upper()])
                    lead = rng.choice([lead, "", f"{some(3)} ", "see "])
            else:
                own = rng.choice([hexes(40), digits(rng.randint(16, 30)), "".join(word() for _ in range(7)), "-".join(word() + word() for _ in range(4)), "/".join(word() + word() for _ in range(4)), mixed(24)])
                lead, quote = rng.choice(["commit ", "sha ", "see ", "order ", "version ", "path ", "checksum: ", some(3) + " ", some(3) + " ", some(3) + " "]), rng.choice(["", "", '"'])
            text, start = f"{some(4)} {lead}{quote}", 0
            start, text = len(text), f"{text}{own}{quote} {some(4)}"
        else:
            if kind == "national_id":
                own, yes = f"{digits(3)}-{digits(2)}-{digits(4)}", ["SSN ", "ssn: ", "social security number ", "tax id ", "national id: "]
            elif kind == "local_phone":
                own, yes = rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), ["call ", "phone: ", "tel ", "mobile ", "reach me on "]
            else:
                own, yes = f"{word()}{rng.choice(['.', '_', ''])}{word()} {rng.choice(['(at)', '[at]', '[ at ]'])} {word()}{rng.choice(['.', ' (dot) ', ' [dot] '])}{rng.choice(['com', 'org', 'net', 'example'])}", ["mail ", "write to ", "contact: ", some(3) + " ", some(3) + " "]
            no = ["part ", "order ", "invoice ", "serial ", "ref ", "version ", "isbn ", some(3) + " "] if kind != "masked_email" else ["page ", "version ", "model "]
            text = f"{some(4)} {rng.choice(yes if good else no)}"
            start, text = len(text), f"{text}{own} {some(4)}"
        x.append(features(text, kind, start, start + len(own)))
        y.append(float(good))
    return np.array(x), np.array(y)


class Selector:
    """The trees, Platt's two numbers and a threshold for each further kind."""

    def __init__(self, training: int = TRAINING, precision: float = PRECISION, seed: int = 7):
        x, y = examples(training, seed)
        part = np.arange(len(y)) % 4  # half for the trees, a quarter to calibrate them, a quarter for thresholds
        held = part == 0
        self.trees = Boosted(x[part > 1], y[part > 1])
        f, t = self.trees(x[held]), y[held]
        a, b = 1.0, 0.0
        smooth = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        for _ in range(50):  # Newton steps of the logistic fit of the held-out answers
            p = 1 / (1 + np.exp(-(a * f + b)))
            g, w = p - smooth, p * (1 - p) + 1e-9
            step = np.linalg.solve(np.array([[(w * f * f).sum() + 1e-6, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-6]]), np.array([(g * f).sum(), g.sum()]))
            a, b = a - step[0], b - step[1]
        self.a, self.b, self.thresholds = a, b, {}
        held = part == 1
        p, t, kinds = self.scores(x[held]), y[held], x[held][:, -1]
        for k, kind in enumerate(FURTHER):
            own, right = p[kinds == k], t[kinds == k]
            fits = [c for c in np.unique(own) if right[own >= c].mean() >= precision]
            if not fits:
                raise ValueError(f"no threshold gives a precision of {precision} for {kind}; ask for less or give more examples")
            self.thresholds[kind] = max(0.5, min(fits))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.trees(x) + self.b, -500, 500)))

    def __call__(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        found = [c for c in candidates(text) if not any(c[1] < e and s < c[2] for _, s, e in taken)]
        if not found:
            return []
        p = self.scores(np.array([features(text, *c) for c in found])).tolist()
        kept: list[tuple[str, int, int, float]] = []
        for q, c in sorted(zip(p, found, strict=True), key=lambda x: (-x[0], x[1][1], x[1])):
            if q >= self.thresholds[c[0]] and not any(c[1] < e and s < c[2] for _, s, e, _ in kept):
                kept.append((*c, q))
        return sorted(kept, key=lambda s: (FURTHER.index(s[0]), s[1]))


@lru_cache(maxsize=4)
def selector(training: int = TRAINING, precision: float = PRECISION) -> Selector:
    return Selector(training, precision)


def spans(text: str | None, select: Selector) -> list[tuple[str, int, int, float]]:
    if not text:
        return []
    base = base_spans(text)
    return [(*s, 1.0) for s in base] + select(text, base)


def find(docs: DataFrame, training: int = TRAINING, precision: float = PRECISION) -> DataFrame:
    """docs with pii: kind, start, stop and score of each span, by kind and then start."""
    shipped = docs.sparkSession.sparkContext.broadcast(selector(training, precision))

    def make():
        select = shipped.value

        def f(batch: pa.RecordBatch) -> dict[str, list]:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return {"pii": [[dict(zip(("kind", "start", "stop", "score"), s, strict=True)) for s in spans(t, select)] for t in texts]}

        return f

    return extend(tidy(docs), make, f"pii {SPANS}")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with its spans replaced by their kinds in square brackets; of overlapping spans the outer or first names the place."""
    parts, done = [], 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, stop)
    return "".join([*parts, text[done:]])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
