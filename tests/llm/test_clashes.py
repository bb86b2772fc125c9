"""Columns whose names differ in case alone, and names that operators use themselves."""

import pytest

from talus.llm import bpe, decontaminate, line_dedup, merkle, near_dedup, pii, quality, substring_dedup
from talus.llm.common import tidy


@pytest.fixture()
def docs(spark):
    ddl = "doc_id long, text string, TEXT string, Doc_Id string, h binary, class int, x double, score string, pii string, ids string, fingerprint string, n_hit string, contaminated int, holder long, key string, edge int"
    row = ("other", "q", b"", 1, 1.0, "s", "p", "i", "f", "n", 0, 1, "k", 2)
    return spark.createDataFrame([(1, "plain words of a text", *row), (None, None, *row)], ddl)


def test_tidy(docs):
    assert tidy(docs).columns[:4] == ["doc_id", "text", "TEXT__2", "Doc_Id__2"]


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: line_dedup.dedup_lines(d), lambda d: substring_dedup.dedup_substrings(d), lambda d: pii.find(d), lambda d: quality.vectors(d), lambda d: merkle.fingerprints(d), lambda d: bpe.digests(d, bpe.default_tokenizer()),
        lambda d: near_dedup.dedup(d), lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "plain words")], "item_id long, text string"), clean=True),
    ],
    ids=["lines", "substrings", "pii", "quality", "merkle", "bpe", "near", "decontaminate"],
)
def test_clashing_names(docs, apply):
    assert apply(docs).count() == 2
