"""Quality classifier: regularised quadratic discriminant analysis.

Each class has its own mean and covariance of the transformed document statistics.  The
covariances are shrunk to a diagonal, factored once by Cholesky, and a score is the
posterior from the difference of the two log densities.  Class moments are sums over all
labelled training rows, added up by Spark; only two rows of sums reach the driver.

Nulls and empty texts are scored like any text (their statistics are zero).  Labels that
are null, or for documents that are absent, are ignored; a document labelled twice counts
twice in training and is still scored once.  With no training rows of either class every
score is the share of label 1 (0.5 if there are none at all).  Repeated rows are scored alike, and train as
often as they occur; very long texts are measured as a whole.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import derive
from waymark.llm.scratch import materialize
from waymark.llm.textstats import base_statistics, transformed

FEATURES = 12
_PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]


def features(text: str | None) -> list[float]:
    s = base_statistics(text)
    w, c = max(s["n_words"], 1), max(s["word_chars"], 1)
    return [
        *transformed(s),
        math.log1p(s["n_words"]),
        s["n_distinct"] / w,
        s["n_short"] / w,
        math.log1p(50 * s["n_digits"] / c),
        math.log1p(20 * s["n_stops"] / w),
        math.log1p(s["n_words"] / max(s["n_lines"], 1)),
    ]


def _features_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return derive(picked, "text", lambda texts: [[features(t) for t in texts]], "x array<double>")


class Discriminant:
    """Two Gaussians with shrunk covariances; holds means, Cholesky factors and log determinants."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float):
        total = sum(n for n, _, _ in moments.values())
        self.prior = moments[1][0] / total
        self.parts = {}
        pooled = sum((ss - np.outer(s, s) / n) for n, s, ss in moments.values()) / total
        scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
        for label, (n, s, ss) in moments.items():
            mean = s / n
            cov = ss / n - np.outer(mean, mean)
            lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * scale + 1e-6 * np.eye(len(mean)))
            inverse = np.linalg.inv(lower)
            self.parts[label] = (mean, inverse, 2 * np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        def log_density(label: int) -> np.ndarray:
            mean, inverse, log_det = self.parts[label]
            return -0.5 * (np.square((x - mean) @ inverse.T).sum(axis=1) + log_det)

        gap = log_density(1) - log_density(0) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, shrinkage: float = 0.1, threshold: float = 0.3
) -> DataFrame:
    """doc_id, held_out, score, predicted: rows whose crc32(doc_id) mod ``folds`` is ``held_fold`` never train."""
    table = materialize(_features_table(docs, id_col, text_col), "quality-features")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    held = F.coalesce(fold == held_fold, F.lit(False))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    train = table.where(~held).join(marks, "doc_id").where("doc_id is not null")
    x = [F.col("x")[i] for i in range(FEATURES)]
    sums = train.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS])
    moments = {}
    for r in sums.collect():  # two rows at most
        ss = np.zeros((FEATURES, FEATURES))
        for i, j in _PAIRS:
            ss[i, j] = ss[j, i] = r[f"p{i}_{j}"]
        moments[r["y"]] = (r["n"], np.array([r[f"s{i}"] for i in range(FEATURES)]), ss)
    if set(moments) == {0, 1}:
        model, constant = Discriminant(moments, shrinkage), None
    else:
        model, constant = None, (1.0 if 1 in moments else 0.0 if 0 in moments else 0.5)

    def apply(vectors: list[list[float]]) -> list:
        return [np.full(len(vectors), constant) if model is None else model.score(np.array(vectors).reshape(-1, FEATURES))]

    scored = derive(table, "x", apply, "score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
