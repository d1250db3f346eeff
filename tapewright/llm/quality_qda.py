"""Operator 8, quality classifier: regularised quadratic discriminant.

Each class of labelled documents has a mean and a covariance of standardised
statistics, shrunk towards a multiple of the identity. The score is the
logistic of the difference of the classes' log-densities, whose Mahalanobis
lengths come from Cholesky factors that are found once and sent along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import document_text, fold, kept
from tapewright.llm.statistics import counts, shares

P = 12
SHRINK, RIDGE, FLAT = 0.1, 1e-3, 40.0


def features(docs: DataFrame) -> DataFrame:
    """doc_id, f0 .. f11 for each document."""
    names = [f"f{i}" for i in range(P)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in spans.chunks(batch["text"]):
                x = shares(counts(data, at))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), *(pa.array(c) for c in x.T)], ["doc_id", *names])

    return document_text(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))


class Discriminant:
    """Fitted from moments: {label: (n, sums, sums of products)}."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        moments = {k: m for k, m in moments.items() if m[0] > 0}
        self.only = {(): 0.5, (0,): 0.0, (1,): 1.0}.get(tuple(sorted(moments)))
        if self.only is not None:
            return
        n = sum(m[0] for m in moments.values())
        self.mean = sum(m[1] for m in moments.values()) / n
        spread = np.diag(sum(m[2] for m in moments.values())) / n - self.mean**2
        self.scale = np.sqrt(np.maximum(spread, 1e-8))
        self.classes = []
        for label in (0, 1):
            k, s, ss = moments[label]
            mean = s / k
            cov = (ss / k - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            cov = (1 - SHRINK) * cov + (SHRINK * max(np.trace(cov) / P, RIDGE) + RIDGE) * np.eye(P)
            factor = np.linalg.cholesky(cov)
            self.classes.append(((mean - self.mean) / self.scale, np.linalg.inv(factor).T, np.log(np.diag(factor)).sum(), np.log(k / n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.mean) / self.scale
        low, high = (prior - half - 0.5 * (((z - mean) @ inverse) ** 2).sum(axis=1) for mean, inverse, half, prior in self.classes)
        return 1 / (1 + np.exp(-np.clip(high - low, -FLAT, FLAT)))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """From all rows of features with labels 0 or 1; only sums come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    sums = [F.count("*").alias("n"), *(F.sum(f"f{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"p{i}_{j}") for i, j in pairs)]
    moments = {}
    for row in rows.join(known, "doc_id").groupBy("y").agg(*sums).collect():
        products = np.zeros((P, P))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        moments[row.y] = (float(row.n), np.array([row[f"s{i}"] for i in range(P)]), products)
    return Discriminant(moments)


def quality_classifier(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; labels of held-out rows are never used.

    Empty and null texts have statistics, too, and are scored. If only one
    class has labels, its label is every score; without labels it is 0.5. Rows
    that repeat are each scored alike, and labels that repeat each count; null
    ids are scored and have no labels. An empty table gives an empty one.
    """
    rows = kept(features(docs), "features")
    model = fit(rows.where(fold(5) != 0), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[f"f{i}"].to_numpy(zero_copy_only=False) for i in range(P)], axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
