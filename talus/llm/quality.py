"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

A document becomes a vector of statistics of its letters, words and lines, each transformed to be near normal. Class means and
covariances come from sums over all labelled training rows, made where the rows are; a class's covariance is shrunk towards the
pooled one and that towards its diagonal. The score is the logistic of the difference of log densities and priors; Mahalanobis
distances use Cholesky factors that are made once and kept with the model. Statistics are made of text alone.

Results that are defined here: a null text is the empty one, which has a vector too; repeated labels of a document each count;
labels that are null, or whose document is missing, don't. Without training rows of both classes the score is the share of label 1
among them, or 0.5 without any. An empty table gives an empty result. A column named like a new one is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extend, map_arrow, table, tidy, written

#: Shares of the pooled covariance in a class's own, and of the diagonal in the pooled one.
SHRINK = 0.1
DIAGONAL = 0.05
FOLDS, HELD_OUT = 3, 1
NAMES = [
    "words", "word_length", "word_length_spread", "capitals", "digits", "marks", "odd_marks", "bars", "distinct", "commonest", "repeated", "line_words",
    "line_distinct", "capital_words", "longest", "marked_words",
]
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 capital, 2 small letter, 3 digit, 4 . or ,, 5 odd mark, 6 bar, 7 other mark, 8 white space
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _chars, _k in ((b".,", 4), (b"#$%&*@^~<>=+\\_{}", 5), (b"|", 6), (b"!?:;'\"()[]/-`", 7), (b" \t\n\r\x0b\x0c", 8)):
    _CLASS[[*_chars]] = _k


def vector(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9).tolist() if raw else [0] * 9
    letters = kinds[0] + kinds[1] + kinds[2] + 1.0
    shown = sum(kinds[:8]) + 1.0
    words = (text or "").split()
    n = len(words) or 1
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in (text or "").split("\n") if x]
    share = lambda k, n, usual, weight: float(np.log((k + weight * usual) / (n + weight) + 0.001))  # noqa: E731  a short text's shares are drawn to the usual ones
    letter, word = lambda k, n, usual: share(k, n, usual, 100.0), lambda k, usual: share(k, len(words), usual, 30.0)
    return [
        float(np.log1p(len(words))), float(np.log1p((lengths.sum() + 50.0) / (len(words) + 10.0))), float(np.log1p(lengths.std())), letter(kinds[1], letters, 0.03), letter(kinds[3], shown, 0.003), letter(kinds[4] + kinds[7], shown, 0.03),
        letter(kinds[5], shown, 0.001), letter(kinds[6], shown, 0.001), float(np.log((len(counts) + 27.0) / (len(words) + 30.0))), word(max(counts.values(), default=0), 0.05), word(sum(a == b for a, b in zip(words, words[1:])), 0.005),  # noqa: B905
        float(np.log1p((len(words) + 20.0) / (len(lines) + 1.0))), ((len({*lines}) + 5.0) / (len(lines) + 5.0)), word(sum(w.isupper() for w in words), 0.01), float(np.log1p(lengths.max())),
        word(sum(not w[-1].isalnum() for w in words), 0.1),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """docs with x array<double>."""

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            return {"x": [vector(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]}

        return f

    return extend(tidy(docs), make, "x array<double>")


@dataclass
class Model:
    """means, inverse Cholesky factors and log determinants of the classes 0 and 1; the log odds of label 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    determinants: list[float]
    odds: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.determinants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(FOLDS) == F.lit(HELD_OUT), F.lit(False))


def fit(rows: DataFrame, shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Model:
    """rows: x and label, 0 or 1."""
    d = len(NAMES)
    i, j = np.triu_indices(d)

    def make():
        def f(batch: pa.RecordBatch) -> dict[str, list]:
            label, x = batch.column(1).to_numpy(zero_copy_only=False), np.array(batch.column(0).to_pylist(), np.float64)
            out: dict[str, list] = {"label": [], "k": [], "v": []}
            for c in (0, 1):
                own = x[label == c]
                sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[i, j]])
                out["label"] += [c] * len(sums)
                out["k"] += range(len(sums))
                out["v"] += sums.tolist()
            return out

        return f

    parts = map_arrow(rows.select("x", F.col("label").cast("int").alias("label")).filter(F.col("label").isin(0, 1)), make, "label int, k int, v double")
    sums = np.zeros((2, 1 + d + len(i)))
    for r in parts.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():  # 2 (1 + d + d (d + 1) / 2) rows
        sums[r.label, r.k] = r.v
    n = sums[:, 0]
    if min(n) < 2:
        return Model([], [], [], 0.0, float(n[1] / sum(n)) if sum(n) else 0.5)
    means, covs = [s[1 : 1 + d] / s[0] for s in sums], []
    for s, m in zip(sums, means, strict=True):
        c = np.zeros((d, d))
        c[i, j] = c[j, i] = s[1 + d :] / s[0]
        covs.append(c - np.outer(m, m))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    lower = [np.linalg.cholesky((1 - shrink) * c + shrink * target) for c in covs]
    return Model(means, [np.linalg.inv(f) for f in lower], [float(np.log(np.diag(f)).sum()) for f in lower], float(np.log(n[1] / n[0])))


def _scored(x: list[list[float]], model: Model) -> dict[str, list]:
    s = model.scores(np.array(x, np.float64).reshape(-1, len(NAMES)))
    return {"score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}


def score(x: DataFrame, model: Model) -> DataFrame:
    """x: vectors(); with score and predicted."""
    shipped = x.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: _scored(batch.column(batch.schema.get_field_index("x")).to_pylist(), shipped.value)

    return extend(x, make, "score double, predicted int", drop=("x",))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted, those that score() gives for vectors(), in one pass: vectors don't go from one worker to another."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: _scored([vector(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], shipped.value)

    return extend(tidy(docs), make, "score double, predicted int")


def train(x: DataFrame, labels: DataFrame) -> Model:
    """x: doc_id and x of documents; labels: doc_id and quality. Held-out rows are left out."""
    labels = tidy(labels).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).dropna().filter(~held_out(F.col("doc_id")))
    return fit(x.select(F.col("doc_id").cast("long").alias("doc_id"), "x").join(labels, "doc_id"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    x = written(vectors(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-x")
    return score(x, train(x, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
