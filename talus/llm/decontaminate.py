"""Benchmark decontamination by a broadcast hash set of test n-grams.

The items' windows of 13 words (or all words of a shorter item) become hashes in a sorted array, beside their places in one array
of word numbers. Training text is cut into words, each word looked up in the benchmark's vocabulary, and windows of known words are
hashed and searched in the array; every hit is verified word by word. What is broadcast is bounded: a benchmark of
more than SLICE_BYTES is dealt into slices by item, and each slice passes over the documents in turn, adding
to their hits. What a pass adds is written before the next one, so that a task never holds more than one slice, and any size works.
A single item is never cut, so a slice may be larger by one item's text.

Results that are defined here: a null or empty text has no words and isn't contaminated; an item without words or
with a null id never hits; items with the same id count once; repeated documents are judged row by row; with an empty
benchmark nothing is hit. A column named like a new one is replaced.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, table, tidy, written

WINDOW = 13
#: A document is contaminated if at least a 20th of its words is hit.
SHARE = 20
#: Bytes of benchmark text in one broadcast.
SLICE_BYTES = 16 << 20

#: Words of a text whose A-Z aren't in lower case yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Of UTF-8 bytes: letters, digits and what isn't ASCII stay, A-Z go to lower case, the rest becomes a space.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out = out * _MULTIPLIER + ids[j : len(ids) - n + 1 + j]
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of a slice of the benchmark, as arrays: of each distinct one its hash, a place of its words and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = sorted({item_id for item_id, _ in items})
        number = {item_id: k for k, item_id in enumerate(self.names)}
        texts, by_length, size = [np.zeros(0, np.uint32)], {}, 0
        for item_id, text in items:
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())], np.uint32)
            n = min(window, len(own))
            if n:
                count = len(own) - n + 1
                by_length.setdefault(n, []).append((_hashes(own, n), np.arange(size, size + count), np.full(count, number[item_id], np.int32)))
                texts.append(own)
                size += len(own)
        self.words = np.concatenate(texts)
        self.sorted = {n: self._grouped(n, *(np.concatenate(x) for x in zip(*by_length[n], strict=True))) for n in sorted(by_length)}

    def _grouped(self, n: int, h: np.ndarray, place: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes in order, first places, and where each one's items start among all items. Different windows with one hash have entries of their own."""
        order = np.lexsort((item, h))
        h, place, item = h[order], place[order], item[order]
        same = np.concatenate([[False], h[1:] == h[:-1]])
        at = np.flatnonzero(same)
        for j in range(n):
            at = at[self.words[place[at] + j] == self.words[place[at - 1] + j]]
        same[:] = False
        same[at] = True
        keep = ~(same & np.concatenate([[False], item[1:] == item[:-1]]))
        first = np.flatnonzero(~same[keep])
        return h[keep][first], place[keep][first], np.append(first, int(keep.sum())), item[keep]

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words, and ids of items."""
        spans, found = [], set()
        if not self.ids or not text_words:
            return spans, found
        ids = np.fromiter(map(self.ids.get, text_words, repeat(0)), np.uint32, len(text_words))
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (known, place, start, item) in self.sorted.items():
            if len(ids) < n or not (clear := strange[n:] == strange[:-n]).any():
                continue
            at = np.flatnonzero(clear)
            h = _hashes(ids, n)[at]
            low = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            seen = set()
            for p, g in zip(at[hit].tolist(), low[hit].tolist(), strict=True):
                own = ids[p : p + n]
                same = known[g]
                while g < len(known) and known[g] == same:
                    if np.array_equal(self.words[place[g] : place[g] + n], own):
                        spans.append((p, p + n))
                        seen.add(g)
                    g += 1
            for g in seen:
                found.update(self.names[k] for k in item[start[g] : start[g + 1]].tolist())
        return spans, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, slice_bytes: int = SLICE_BYTES, clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids as strings) and contaminated; clean: also clean_text, the text without its hit words."""
    spark = docs.sparkSession
    docs, items = tidy(docs), tidy(benchmark).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0)).alias("b")).first().b
    n = max(1, -(-size // slice_bytes))
    out = docs.withColumns({"__from": F.lit(None).cast("array<int>"), "__to": F.lit(None).cast("array<int>"), "__items": F.lit(None).cast("array<string>")})
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()  # a slice of the benchmark, of about slice_bytes
        shipped = spark.sparkContext.broadcast(Windows([(r.item_id, r.text) for r in rows], window))
        last = k == n - 1

        def make(shipped=shipped, last=last):
            windows = shipped.value

            def f(batch: pa.RecordBatch) -> dict[str, list]:
                col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("text", "__from", "__to", "__items")}
                out = {c: [] for c in (("n_words", "n_hit", "items", "contaminated", "clean_text") if last else ("__from", "__to", "__items"))}
                for raw, start, stop, ids in zip(col["text"].cast(pa.binary()).to_pylist(), *(col[c].to_pylist() for c in ("__from", "__to", "__items")), strict=True):
                    own = words(raw or b"")
                    spans, found = windows.hits(own)
                    spans = sorted({*spans, *zip(start or [], stop or [], strict=True)})
                    found |= {*(ids or [])}
                    if not last:
                        out["__from"].append([s for s, _ in spans])
                        out["__to"].append([e for _, e in spans])
                        out["__items"].append(sorted(found))
                        continue
                    runs: list[list[int]] = []
                    for s, e in spans:
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(e, runs[-1][1])
                        else:
                            runs.append([s, e])
                    n_hit = sum(e - s for s, e in runs)
                    out["n_words"].append(len(own))
                    out["n_hit"].append(n_hit)
                    out["items"].append(sorted(found))
                    out["contaminated"].append(n_hit > 0 and share * n_hit >= len(own))
                    out["clean_text"].append(None if not clean or raw is None else cut(raw.decode(), runs))
                return out

            return f

        own = "n_words long, n_hit long, items array<string>, contaminated boolean, clean_text string"
        out = extend(out, make, own if last else "__from array<int>, __to array<int>, __items array<string>", drop=("__from", "__to", "__items") if last else ())
        if not last:
            out = written(out, "decontaminate")
    return out if clean else out.drop("clean_text")


def cut(text: str, runs: list[list[int]]) -> str:
    """text without the words of the runs, from the first letter of a run to its last."""
    if not runs:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    parts, done = [], 0
    for s, e in runs:
        parts.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return "".join([*parts, text[done:]])


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
bp AS (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bp),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bl)),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM dp) JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
