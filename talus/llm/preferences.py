"""Preference formatting of chat pairs, in DataFrame expressions alone.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (equal role and text) is rendered once as the prompt; the
other turns of each become its completion. A mask of the same length has 1 for each character of a completion that is trained on, the text and end
mark of assistant turns, and 0 for the rest. What looks like a mark in a role or text is broken up with a space.

Results that are defined here: a null role or text is the empty one. Turns are ordered by turn, role and text, a null turn first;
repeated turns all stay. Equal conversations have empty completions, and so has one that is a prefix of the other. A pair without one of its
sides has an empty conversation there. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, tidy

START, END = "<|im_start|>", "<|im_end|>"
#: Conversations of the query that swap last answers: those whose ids agree but for this many bits.
BLOCK_BITS = 6


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """key and turns, an array of (turn, role, text)."""
    safe = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = tidy(turns)
    return turns.groupBy(F.col(key).cast("long").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), safe("role").alias("role"), safe("text").alias("text")))).alias("turns"))


def pair_up(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, chosen and rejected of two tables of turns."""
    a = conversations(chosen, key).withColumnRenamed("turns", "chosen")
    b = conversations(rejected, key).select(F.col(key).alias("__key"), F.col("turns").alias("rejected"))
    both = a.join(b, a[key].eqNullSafe(b["__key"]), "full_outer")
    none = F.array().cast(a.schema["chosen"].dataType)
    return both.select(F.coalesce(key, "__key").alias(key), F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    trained = lambda t: F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
    each = lambda t: F.concat(F.repeat(F.lit("0"), F.length(_head(t))), F.repeat(trained(t), F.length(t["text"]) + F.lit(len(END))), F.lit("0"))
    return F.array_join(F.transform(turns, each), "")


def preference_format(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, n_prefix, prompt, and of both sides the completion and its mask."""
    alike = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(alike, F.lit(False))
    df = pairs.withColumn("__at", at).withColumn("n_prefix", F.when(F.col("__at") == 0, F.size("chosen").cast("long")).otherwise(F.col("__at") - 1))
    rest = lambda side: F.slice(side, F.col("n_prefix").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))
    df = df.withColumns({"prompt": _render(F.slice("chosen", F.lit(1), F.col("n_prefix").cast("int"))), "chosen": rest("chosen"), "rejected": rest("rejected")})
    sides = [c for side in ("chosen", "rejected") for c in (_render(F.col(side)).alias(side), _mask(F.col(side)).alias(f"{side}_mask"))]
    return df.select(key, "n_prefix", "prompt", *sides)


def swapped(turns: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Pairs from conversations alone: chosen is each as it is, rejected has the last answer of the next conversation of its block in the place of its own.

    Blocks are of conversations whose ids agree but for the last bits, so none has more than 2 ** bits. The last answer is the last turn of an
    assistant, or the last turn where there is none.
    """
    df = conversations(turns, "conv_id").withColumn("__back", F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == "assistant")), F.lit(True)))
    df = df.withColumn("__last", F.size("turns") - F.greatest(F.col("__back"), F.lit(1)).cast("int"))
    df = df.withColumn("__answer", F.get("turns", F.col("__last"))["text"])
    own = Window.partitionBy(F.shiftright("conv_id", bits)).orderBy("conv_id")
    df = df.withColumn("__other", F.coalesce(F.lead("__answer").over(own), F.first("__answer").over(own)))
    swap = lambda t, i: F.when(i == F.col("__last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("__other").alias("text"))).otherwise(t)
    return df.select("conv_id", F.col("turns").alias("chosen"), F.transform("turns", swap).alias("rejected"))


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference_format(swapped(table(spark, sf_dir, "conversations")), "conv_id")


SQL = r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
l AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), max(i)) AS last FROM o GROUP BY conv_id),
a AS (SELECT l.conv_id, l.last, o.text AS answer FROM l JOIN o ON o.conv_id = l.conv_id AND o.i = l.last),
w AS (SELECT conv_id, last, coalesce(lead(answer) OVER b, first_value(answer) OVER b) AS other FROM a WINDOW b AS (PARTITION BY conv_id >> 6 ORDER BY conv_id)),
r AS (SELECT o.conv_id, o.i, o.n, o.role, o.text AS c, CASE WHEN o.i = w.last THEN w.other ELSE o.text END AS r FROM o JOIN w USING (conv_id)),
p AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE c <> r) - 1, max(n)) AS n_prefix FROM r GROUP BY conv_id),
s AS (SELECT r.*, p.n_prefix, '<|im_start|>' || role || chr(10) AS head, CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS bit FROM r JOIN p USING (conv_id))
SELECT conv_id, any_value(n_prefix)::BIGINT AS n_prefix,
       coalesce(string_agg(head || c || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i <= n_prefix), '') AS prompt,
       coalesce(string_agg(head || c || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS chosen,
       coalesce(string_agg(repeat('0', length(head)) || repeat(bit, length(c) + 10) || '0', '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(head || r || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS rejected,
       coalesce(string_agg(repeat('0', length(head)) || repeat(bit, length(r) + 10) || '0', '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS rejected_mask
FROM s GROUP BY conv_id
"""
