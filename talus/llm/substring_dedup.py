"""Substring dedup by compaction of a De Bruijn graph of word k-mers.

The edges of the graph are k-mers of K = 25 words. Of the k-mers of each window of 50 words the one with the least hash is kept, so
that equal windows keep the same edge; the run of windows that keep an edge is its path, 50 to 75 words of one document. An edge all of
whose occurrences have one path is not branching: the path stands for all its windows, which are compacted into one record with
the least doc_id that holds it. Edges with several paths branch; there paths are told apart by their words, and only for the first
document of each are windows looked at one by one. Paths join back to the occurrences, and those of a document merge into its repeated spans. Paths and
windows count as equal if 128 bits of their words' digests agree (edges, which are 64-bit hashes, never decide alone).

Nothing is done by pairs of documents: each key keeps its least doc_id, which is aggregated before the shuffle, and joins
are by key with that one row, so that hot keys can be split.

Results that are defined here: a null text has no words and stays null; a document of fewer than 50 words keeps them all. Rows with the same doc_id
are each judged by their own text and do not remove each other's words. Rows with a null doc_id are left as they are and remove nothing. An empty table gives an empty result. A
column named like a new one is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, map_arrow, table, tidy, written
from .spans import Words, least

WINDOW = 50
K = 25


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def paths(text: bytes, window: int = WINDOW, k: int = K) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of text; of each of its paths the edge's hash, the first window and the last."""
    w = Words(b" ".join(text.split()))
    if w.n < window:
        none = np.zeros(0, np.int64)
        return w, none, none, none
    h = w.kmers(k)
    at = least(h, window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return w, h[at[first]].view(np.int64), first, last


def occurrences(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs: doc_id, row and text. edge, path (64 bits of its words' digest), doc_id, row, first window and count of windows, for each path of each document."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            edges, keys, ids, rows, starts, counts = [], [], [], [], [], []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                w, edge, first, last = paths(text or b"", window, k)
                if len(edge):
                    raw, a, z = w.text, w.starts[first].tolist(), w.ends[last + window - 1].tolist()
                    edges.append(edge)
                    keys.append(np.frombuffer(b"".join([_key(raw[s:e]) for s, e in zip(a, z, strict=True)]), "<i8"))
                    ids.append(np.full(len(edge), doc_id))
                    rows.append(np.full(len(edge), row))
                    starts.append(first)
                    counts.append(last - first + 1)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, keys, ids, rows, starts, counts)]
            return dict(zip(("edge", "path", "doc_id", "row", "first", "n"), (pa.array(x.astype(t)) for x, t in zip(flat, ("i8", "i8", "i8", "i8", "i4", "i4"), strict=True)), strict=True))

        return f

    return map_arrow(docs.select("doc_id", "row", "text"), make, "edge long, path long, doc_id long, row long, first int, n int")


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, row, text and at, an array of (first, n). high and low of the digest, doc_id, row and at of each window of those runs."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            digests, ids, rows, at = [], [], [], []
            for doc_id, row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = Words(b" ".join((text or b"").split()))
                for i in sorted({i for r in runs for i in range(r["first"], r["first"] + r["n"]) if i + window <= w.n}):
                    digests.append(hashlib.blake2b(w.bytes_of(i, i + window), digest_size=16).digest())
                    ids.append(doc_id)
                    rows.append(row)
                    at.append(i)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return {"high": pa.array(np.ascontiguousarray(both[:, 0])), "low": pa.array(np.ascontiguousarray(both[:, 1])), "doc_id": ids, "row": rows, "at": at}

        return f

    return map_arrow(docs, make, "high long, low long, doc_id long, row long, at int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs: doc_id and text. doc_id, row (a hash of the text, so that rows with the same doc_id are told apart) and spans, an array of (first word, count of words) that a document with a smaller doc_id also has."""
    docs = docs.filter(F.col("doc_id").isNotNull()).withColumn("row", F.xxhash64("text"))
    seen = occurrences(docs, window, k)
    edges = seen.groupBy("edge").agg(F.min("path").alias("p0"), F.max("path").alias("p1"), F.min("doc_id").alias("least"), F.max("doc_id").alias("d1")).filter(F.col("least") < F.col("d1"))
    # written, so that both sides of the join are dealt anew and a hot edge's occurrences can be split
    edges = written(edges.select("edge", "least", (F.col("p0") != F.col("p1")).alias("branches")), "substring-edges")
    # what repeats: the occurrences on edges of two documents or more
    repeats = written(seen.join(edges, "edge"), "substring-repeats")
    split = written(repeats.filter("branches").groupBy("edge", "path").agg(F.min("doc_id").alias("own")), "substring-paths")
    branching = repeats.filter("branches").join(split, ["edge", "path"])
    whole = F.struct("first", (F.col("n") + F.lit(window - 1)).alias("n"))
    spans = repeats.filter("NOT branches AND least < doc_id").select("doc_id", "row", whole.alias("span"))
    spans = spans.unionByName(branching.filter("own < doc_id").select("doc_id", "row", whole.alias("span")))
    # the first document of a path of a branching edge: its windows may be those of another path
    single = branching.filter("own = doc_id").groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("at"))
    seen_windows = written(windows(docs.join(single, ["doc_id", "row"]).select("doc_id", "row", "text", "at"), window), "substring-windows")
    oldest = seen_windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("d1")).filter(F.col("least") < F.col("d1")).drop("d1")
    oldest = written(oldest, "substring-oldest")
    later = seen_windows.join(oldest, ["high", "low"]).filter(F.col("least") < F.col("doc_id"))
    spans = spans.unionByName(later.select("doc_id", "row", F.struct(F.col("at").alias("first"), F.lit(window).alias("n")).alias("span")))
    return spans.groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with n_words and n_removed; the text of a document that loses words is the rest with one space between, others keep theirs."""
    docs = tidy(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = repeated_spans(docs.select("doc_id", "text"), window, k).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, (docs["doc_id"] == spans["__doc"]) & (F.xxhash64(docs["text"]) == spans["__row"]), "left").drop("__doc", "__row")

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"text": [], "n_words": [], "n_removed": []}
            col = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "__spans")]
            for text, spans in zip(*col, strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or []:
                    gone[s["first"]] += 1
                    gone[s["first"] + s["n"]] -= 1
                left = np.cumsum(gone[:-1]) == 0
                removed = len(words) - int(left.sum())
                out["text"].append(b" ".join([w for w, keep in zip(words, left.tolist(), strict=True) if keep]).decode() if removed else text)
                out["n_words"].append(len(words))
                out["n_removed"].append(removed)
            return out

        return f

    return extend(joined, make, "text string, n_words long, n_removed long", drop=("__spans",))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS least FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN m USING (win) WHERE least < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
j AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) FILTER (WHERE g.k IS NULL) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN j USING (doc_id)
"""
