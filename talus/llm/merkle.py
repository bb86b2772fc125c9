"""Document fingerprints: a Merkle tree over passages, paragraphs and sections, in DataFrame expressions alone.

A paragraph is a line. Its passages are runs of up to PASSAGE words with the white space around them, counted anew in each line, so an
edit changes the passages it touches and those after it in its line only. A section ends with a paragraph whose hash begins with 0 to 3 and
with the last one, so sections fall into step again after an edit. Passages hash their text; each level above hashes its children's hashes,
all by SHA-256. Roots are equal if, and but for collisions only if, the texts are. The fingerprint has the root, then the first 8 hex digits of each
section, each paragraph and each passage (those of a paragraph before a dot). The likeness of two fingerprints is twice the number
of distinct passages in both, by the number in each: 1 for equal trees, also for two without passages, 0 for nothing in common.

To find each document's next one without sorting all rows in one task, doc_ids are cut into ranges at values that occur; the first document of
a range also goes to the range before as its guard, the very first to the last range.

Results that are defined here: a null text is the empty one, one paragraph without passages. A null doc_id comes before all others; rows
with the same doc_id are ordered by text. A single document is its own next one. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, table

PASSAGE = 8
_PATTERN = "[\\x20\\x09-\\x0D]*(?:[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*){1,%d}|[\\x20\\x09-\\x0D]+"
_LEAST = -(1 << 63)


def tree(df: DataFrame, text: str, name: str, passage: int = PASSAGE) -> DataFrame:
    """df with name_passages (an array for each paragraph), name_paragraphs, name_sections and name_root."""
    pattern, up = F.lit(_PATTERN % passage), lambda x: F.sha2(F.array_join(x, ""), 256)
    hashed = lambda line: F.transform(F.regexp_extract_all(line, pattern, F.lit(0)), lambda p: F.sha2(p, 256))
    df = df.withColumn(f"{name}_passages", F.transform(F.split(text, "\n"), hashed))
    df = df.withColumn(f"{name}_paragraphs", F.transform(f"{name}_passages", up))
    own, n = F.col(f"{name}_paragraphs"), F.size(f"{name}_paragraphs")
    df = df.withColumn("__ends", F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(own, i) < F.lit("4")))))
    ends = F.col("__ends")
    section = lambda j: up(F.slice(own, F.get(ends, j - 1) + 1, F.get(ends, j) - F.get(ends, j - 1)))
    df = df.withColumn(f"{name}_sections", F.transform(F.sequence(F.lit(1), F.size(ends) - 1), section)).drop("__ends")
    return df.withColumn(f"{name}_root", up(F.col(f"{name}_sections")))


def _short(x: Column) -> Column:
    return F.transform(x, lambda h: F.substring(h, 1, 8))


def fingerprint(name: str) -> Column:
    """Of the columns of tree()."""
    passages = F.array_join(F.transform(f"{name}_passages", lambda p: F.concat(F.array_join(_short(p), ""), F.lit("."))), "")
    return F.concat_ws(":", F.col(f"{name}_root"), F.array_join(_short(F.col(f"{name}_sections")), ""), F.array_join(_short(F.col(f"{name}_paragraphs")), ""), passages)


def passages(name: str) -> Column:
    return F.array_distinct(_short(F.flatten(f"{name}_passages")))


def likeness(a: Column, b: Column) -> Column:
    """Of the passages() of two trees."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / n)


def edits(a: str, b: str) -> Column:
    """The differing branches of two trees with those names: places (from 0) of paragraphs of a that b lacks."""
    return F.filter(F.sequence(F.lit(0), F.size(f"{a}_paragraphs") - 1), lambda i: ~F.array_contains(F.col(f"{b}_paragraphs"), F.get(F.col(f"{a}_paragraphs"), i)))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id and text) with next_text, that of the next document in ascending doc_id order, after the last one the first."""
    docs = docs.withColumn("__key", F.coalesce("doc_id", F.lit(_LEAST)))
    cuts = docs.agg(F.min("__key").alias("low"), F.percentile_approx("__key", [i / ranges for i in range(1, ranges)] or [0.5], 50 * ranges).alias("cuts")).first()
    if cuts.low is None:
        return docs.withColumn("next_text", F.col("text")).drop("__key")
    cuts = sorted({cuts.low, *cuts.cuts}) if ranges > 1 else [cuts.low]
    step = max(1, int(len(cuts) ** 0.5))  # two levels, so that a document is compared with few of them
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    below = lambda x: F.size(F.filter(x, lambda v: v <= F.col("__key")))
    docs = docs.withColumn("__group", below(longs([g[0] for g in groups])))
    docs = docs.withColumn("__range", (F.col("__group") - 1) * step + below(F.element_at(F.array(*map(longs, groups)), F.col("__group"))) - 1)
    before = F.when(F.array_contains(F.element_at(F.array(*map(longs, groups)), F.col("__group")), F.col("__key")), F.pmod(F.col("__range") - 1, F.lit(len(cuts))))
    place = lambda at, guard: F.struct(at.cast("int").alias("at"), F.lit(guard).alias("guard"))
    places = F.when(before.isNull(), F.array(place(F.col("__range"), False))).otherwise(F.array(place(F.col("__range"), False), place(before, True)))
    docs = docs.withColumn("__place", F.explode(places)).select("doc_id", "text", "__key", F.col("__place.at").alias("__at"), F.col("__place.guard").alias("__guard"))
    order = Window.partitionBy("__at").orderBy("__guard", "__key", "text")
    return docs.withColumn("next_text", F.lead("text").over(order)).filter("NOT __guard").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprints of each text and of its edited text, and likenesses."""
    spark = docs.sparkSession
    ranges = ranges or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = with_next(documents(docs), ranges).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    for text, name in (("text", "own"), ("edited", "edited"), ("next_text", "next")):
        df = tree(df, text, name).withColumn(f"{name}_set", passages(name))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx, length(t) AS n FROM d),
e AS (SELECT doc_id, n, t, nx, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) AS ed FROM x),
k AS (SELECT doc_id, 1 AS kind, t AS s FROM e UNION ALL SELECT doc_id, 2, ed FROM e UNION ALL SELECT doc_id, 3, nx FROM e),
p AS (SELECT doc_id, kind, list_transform(string_split(s, chr(10)), lambda l: list_transform(regexp_extract_all(l, '[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,8}|[\x20\x09-\x0D]+'), lambda q: sha256(q))) AS leaves FROM k),
q AS (SELECT *, list_transform(leaves, lambda l: sha256(array_to_string(l, ''))) AS pars FROM p),
r AS (SELECT *, list_filter(range(1, len(pars) + 1), lambda i: i = len(pars) OR pars[i] < '4') AS ends FROM q),
s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda j: sha256(array_to_string(pars[coalesce(ends[j - 1], 0) + 1:ends[j]], ''))) AS secs FROM r),
f AS (SELECT doc_id, kind, concat_ws(':', sha256(array_to_string(secs, '')), array_to_string(list_transform(secs, lambda h: h[1:8]), ''), array_to_string(list_transform(pars, lambda h: h[1:8]), ''),
        array_to_string(list_transform(leaves, lambda l: array_to_string(list_transform(l, lambda h: h[1:8]), '') || '.'), '')) AS fp,
        list_distinct(list_transform(flatten(leaves), lambda h: h[1:8])) AS own FROM s)
SELECT e.doc_id, e.n AS n_chars, sha256(e.ed) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       CASE WHEN len(a.own) + len(b.own) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.own, b.own)) / (len(a.own) + len(b.own)) END AS near_edited,
       CASE WHEN len(a.own) + len(c.own) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.own, c.own)) / (len(a.own) + len(c.own)) END AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 2 JOIN f c ON c.doc_id = e.doc_id AND c.kind = 3
"""
