"""Line dedup by levelled sorted runs of line hashes.

Each batch of documents becomes a sorted run: a row for each line key with the number of documents that
hold it and its holder, the largest doc_id seen with it. Batches come in descending doc_id order, so that a
merge anti join with the older runs tells the keys that are new; only those get their holder from the batch.
When a level has `fanout` runs they are merged into one run of the next level, as in a log-structured merge
tree. Keys are 128-bit digests, which count as the lines themselves.

Results that are defined here: a null text is the empty text, one empty line. Each row is a document, so repeated
rows count for themselves; rows that share the largest doc_id of a key all keep it. A null doc_id is smaller
than any other. An empty table gives an empty result. A column named like a new one is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, digest, extend, map_arrow, same, table, tidy, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Bytes of text that two batches are enough for; there is one batch more for each four times as many. Runs of a level before they are merged.
BATCH_BYTES = 32 << 20
FANOUT = 2


def line_key(line: str, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    return digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None  # bytes.lower() changes A-Z alone


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and key, once for each row of docs and key."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and len(text) >= min_chars:
                    own = {k for x in text.split("\n") if len(x) >= min_chars and (k := line_key(x, min_chars))}
                    keys.extend(own)
                    ids.extend([doc_id] * len(own))
            return {"doc_id": ids, "key": keys}

        return f

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, key binary")


class LineRuns:
    """The levels of sorted runs. A run has key, n_docs and holder."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    def all(self) -> DataFrame | None:
        """All runs merged: a row for each key."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        if len(runs) == 1:
            return runs[0]
        df = runs[0]
        for r in runs[1:]:
            df = df.unionByName(r)
        return df.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id and key of a batch whose doc_ids lie below those of the batches before it."""
        own = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        older = [r for level in self.levels for r in level]
        if older:  # merge anti join: what no older run holds is new here and keeps its holder; for the rest only the count is added
            keys = older[0].select("key")
            for r in older[1:]:
                keys = keys.unionByName(r.select("key"))
            own = written(own, "lines-batch")
            fresh = own.join(keys.hint("merge"), "key", "left_anti")
            known = own.join(keys.distinct().hint("merge"), "key", "left_semi").withColumn("holder", F.lit(None).cast("long"))
            own = fresh.unionByName(known)
        self._put(0, own)

    def _put(self, level: int, df: DataFrame) -> None:
        run = written(df.repartition("key").sortWithinPartitions("key"), f"lines-run{level}")
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._put(level + 1, merged)


def batches(docs: DataFrame, n: int | None = None) -> list[DataFrame]:
    """docs in n slices of about as many rows by doc_id, the largest ids first; nulls go to the last. By default n follows the size, slowly, as each slice reads the table."""
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
        n = 2 + (max(1, size // BATCH_BYTES).bit_length() - 1) // 2
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(n - 1, 0, -1)], 1000).alias("c")).first().c if n > 1 else []
    cuts = list(dict.fromkeys(cuts or []))
    doc_id, out, top = F.col("doc_id"), [], None
    for cut in [*cuts, None]:
        part = docs.filter(doc_id > cut) if cut is not None else docs
        if top is not None:
            part = part.filter((doc_id <= top) | doc_id.isNull() if cut is None else doc_id <= top)
        out.append(part)
        top = cut
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int | None = None, runs: LineRuns | None = None) -> DataFrame:
    """docs with text less its dropped lines, n_lines (before) and n_dropped.

    A key of at least min_chars code points that at least min_docs documents hold stays in its holder alone.
    runs: those of earlier calls, to go on with; documents of this call count as older than theirs.
    """
    docs = tidy(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    runs = runs or LineRuns()
    for part in batches(docs, n_batches):
        runs.add(line_keys(part, min_chars))
    common = written(runs.all().filter(F.col("n_docs") >= min_docs).select("key", "holder"), "lines-common")
    lines = line_keys(docs, min_chars)
    drops = lines.join(common, "key").filter(~same(F.col("doc_id"), F.col("holder"))).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("__drop"))
    joined = docs.join(drops, same(docs["doc_id"], drops["__doc"]), "left").drop("__doc")

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            texts, n_lines, n_dropped = [], [], []
            column = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "__drop")}
            for text, drop in zip(column["text"], column["__drop"], strict=True):
                lines = (text or "").split("\n")
                left = lines
                if drop:
                    gone = set(drop)
                    left = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in gone]
                texts.append("\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            return {"text": texts, "n_lines": n_lines, "n_dropped": n_dropped}

        return f

    return extend(joined, make, "text string, n_lines long, n_dropped long", drop=("__drop",))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.holder) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE c.key IS NULL OR k.doc_id = c.holder), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.r, k.doc_id
"""
