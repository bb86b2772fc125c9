"""The corpus pipeline: documents in, token ids' digests out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which run() writes as Parquet and
reads again as the next one's docs. All but the last return the columns of their input: doc_id, text and whatever else there is;
n_chars follows the text. An empty input gives an empty result in each stage.

No task of a stage has two Python steps. Each would have a worker of its own; workers live on and take turns, so twice as many as there are cores
would each hold the last stage's tokenizer and pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from talus.llm.common import shared, table, tidy, written


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one, so that no name of theirs clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__")).alias("__row"))


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from an _apart() frame; n_chars is that of the text."""
    cols = []
    for name, kind in docs.dtypes:
        if name in ("doc_id", "text"):
            cols.append(F.col(name).cast(kind).alias(name))
        elif name == "n_chars":
            cols.append(F.coalesce(F.length("text"), F.lit(0)).cast(kind).alias(name))
        else:
            cols.append(F.col("__row")[name].alias(name))
    return df.select(*cols)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as 1; it is trained on the labelled ones of its input that aren't held out."""
    docs = tidy(docs)
    x = written(quality.vectors(docs.select("doc_id", "text")).drop("text"), "quality-x")
    model = quality.train(x, table(spark, sf_dir, "labels"))
    return _back(quality.score_texts(_apart(docs), model).filter("predicted = 1"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that five or more hold, which stay in the last one."""
    docs = tidy(docs)
    return _back(line_dedup.dedup_lines(_apart(docs)), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.dedup(docs, by="words")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose the words that benchmark windows hit."""
    docs = tidy(docs)
    found = decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark"), clean=True)
    return _back(found.filter("NOT contaminated").withColumn("text", F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor weighted sampling nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
