import numpy as np

from talus.llm import quality as q

GOOD = "This is a plain sentence of some length, and another clause follows it.\nThe next line says a little more, as lines do."


def test_vector_of_edge_cases():
    for text in (None, "", " \n ", "x", "word " * 50_000, "漢字🙂", "!!!"):
        v = q.vector(text)
        assert len(v) == len(q.NAMES) and np.isfinite(v).all()
    assert q.vector(None) == q.vector("")


def test_densities_like_the_formula(spark):
    rng = np.random.default_rng(5)
    d = len(q.NAMES)
    x = {0: rng.normal(1, 2, (60, d)), 1: rng.normal(-1, 1, (90, d))}
    rows = [(v.tolist(), c) for c in x for v in x[c]] + [([0.0] * d, None), ([0.0] * d, 7)]
    m = q.fit(spark.createDataFrame(rows, "x array<double>, label int").repartition(3))
    covs = [np.cov(x[c].T, bias=True) for c in (0, 1)]
    pooled = (60 * covs[0] + 90 * covs[1]) / 150
    target = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    at, want = rng.normal(0, 1, (20, d)), []
    for v in at:
        ll = []
        for c in (0, 1):
            s, m0 = 0.9 * covs[c] + 0.1 * target, x[c].mean(axis=0)
            ll.append(-0.5 * (v - m0) @ np.linalg.solve(s, v - m0) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(x[c]) / 150))
        want.append(1 / (1 + np.exp(ll[0] - ll[1])))
    assert np.allclose(m.scores(at), want, atol=1e-9)


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, GOOD, "a") for i in range(6)] + [(None, None, "b")], "doc_id long, text string, score string")
    x = q.vectors(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.score(x, q.train(x, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(6)] + [(3, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in q.score(x, q.train(x, one)).collect()} == {1.0}
    empty = q.vectors(docs.limit(0))
    assert q.score(empty, q.train(empty, one)).count() == 0


def test_held_out_accuracy(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test data")
    out = q.op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.9


def test_texts_score_like_their_vectors(spark):
    docs = spark.createDataFrame([(i, GOOD[i:] * (i % 3), "a") for i in range(40)] + [(None, None, "b")], "doc_id long, text string, score string")
    x = q.vectors(docs)
    model = q.train(x, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    a, b = q.score(x, model), q.score_texts(docs, model)
    assert a.columns == b.columns and len(model.means) == 2
    for r, s in zip(sorted(a.collect(), key=str), sorted(b.collect(), key=str), strict=True):
        assert (r.doc_id, r.text, r.predicted) == (s.doc_id, s.text, s.predicted) and abs(r.score - s.score) < 1e-12
