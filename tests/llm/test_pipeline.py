"""The pipeline's stages against their operators, and its last rows against brute force."""

import hashlib
import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(D), reason="no test data")


def test_stages(spark):
    from tokenizers import Tokenizer

    from talus.llm import bpe, decontaminate, line_dedup, near_dedup, quality
    from talus.llm.common import table

    docs = table(spark, D, "documents")
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, before, D).collect(), before.schema)
        assert out.columns == docs.columns and out.schema == docs.schema
        rows, had = by_id(out), by_id(before)
        assert set(rows) <= set(had) and all(r.n_chars == len(r.text) and (r.lang, r.source) == (had[i].lang, had[i].source) for i, r in rows.items())
        kept[name] = (had, rows)
        before = out
    had, rows = kept["quality"]
    x = quality.vectors(docs)
    model = quality.train(x, table(spark, D, "labels"))
    good = {r.doc_id for r in quality.score(x, model).filter("predicted = 1").collect()}
    assert set(rows) == good and all(rows[i].text == had[i].text for i in rows)
    had, rows = kept["line_dedup"]
    assert set(rows) == set(had)
    lines = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(had.values()), docs.schema)))
    assert all(rows[i].text == lines[i].text for i in rows)
    had, rows = kept["near_dedup"]
    classes = near_dedup.near_classes(spark.createDataFrame(list(had.values()), docs.schema)).collect()
    assert set(rows) == {r["class"] for r in classes} and all(rows[i].text == had[i].text for i in rows)
    had, rows = kept["decontamination"]
    found = by_id(decontaminate.decontaminate(spark.createDataFrame(list(had.values()), docs.schema), table(spark, D, "benchmark")))
    assert set(rows) == {i for i, r in found.items() if not r.contaminated}
    assert all(rows[i].text == had[i].text for i in rows if not found[i].n_hit)
    tk = Tokenizer.from_file(bpe.default_tokenizer())
    for r in corpus_pipeline.STAGES[-1][1](spark, before, D).collect():
        ids = tk.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_input_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A plain text of a few words.", "en", 2.5, "q"), (None, None, None, None, None)], "doc_id long, text string, score string, x double, n_lines string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
        assert stage(spark, docs.limit(0), D).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), D).count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, docs, D).count() == 2


def test_one_python_step_a_task(spark, monkeypatch):
    """Two steps take two workers a core, which take turns later on; all of them then hold the tokenizer."""
    from talus.llm import quality

    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows) or fit(rows))
    out = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{D}/documents.parquet"), D)
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert steps(out) == 1 and [steps(rows) for rows in seen] == [0]  # fit() adds the one of its task
