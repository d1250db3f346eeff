"""Operator 5, quality rules: an isolation forest on rule statistics.

The forest is TREES trees of LEAVES documents each, every tree's drawn from the
whole table: documents in the order of a hash of their ids are dealt LEAVES to a
tree, so no document is in two trees while there are enough for all (with fewer,
each tree draws from all). A split takes a random statistic
and a random value between the least and the greatest at the node. A document
is the more odd, the shorter its mean path. The path length at which documents
are rejected is calibrated on all rows with labels: it gives the greatest
difference of the shares of bad and of good documents that are rejected, where
a lost good document weighs GOOD times a missed bad one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import kept, least_hashed
from tapewright.llm.statistics import NAMES, matrix, shares, statistics

TREES, LEAVES, SEED = 200, 256, 11
GOOD = 4.0
#: Which of the shares are rule statistics.
RULES = (0, 1, 2, 6, 8, 9)
STEPS = 2000


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a random tree over n points."""
    n = np.maximum(n, 1).astype(np.float64)
    out = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, value, path) for each tree and node; node i has children 2i + 1 and 2i + 2, a leaf the statistic -1."""
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(LEAVES)))
    size = 2 ** (depth + 1) - 1
    which, value, path = np.full((TREES, size), -1, np.int16), np.zeros((TREES, size)), np.zeros((TREES, size))
    for tree in range(TREES):
        if len(points) >= TREES * LEAVES:
            own = points[tree * LEAVES : (tree + 1) * LEAVES]
        else:
            own = points[rng.choice(len(points), min(LEAVES, len(points)), replace=False)] if len(points) else points
        stack = [(0, own, 0)]
        while stack:
            node, here, level = stack.pop()
            low, high = (here.min(axis=0), here.max(axis=0)) if len(here) else (np.zeros(points.shape[1]), np.zeros(points.shape[1]))
            able = np.flatnonzero(high > low)
            if level == depth or not len(able):
                path[tree, node] = level + _mean_path(np.array(len(here)))
                continue
            k = rng.choice(able)
            cut = rng.uniform(low[k], high[k])
            which[tree, node], value[tree, node] = k, cut
            stack += [(2 * node + 1, here[here[:, k] < cut], level + 1), (2 * node + 2, here[here[:, k] >= cut], level + 1)]
    return which, value, path


def oddness(points: np.ndarray, forest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each point, higher for shorter paths."""
    which, value, path = forest
    total = np.zeros(len(points))
    for tree in range(len(which)):
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows):
            k = which[tree, node[rows]]
            rows, k = rows[k >= 0], k[k >= 0]
            at = node[rows]
            node[rows] = 2 * at + 1 + (points[rows, k] >= value[tree, at])
        total += path[tree, node]
    return 2.0 ** (-total / len(which) / _mean_path(np.array(LEAVES)))


def _scored(stats: DataFrame, forest: tuple) -> DataFrame:
    """doc_id, the statistics and oddness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = shares(matrix(batch))[:, RULES]
            same, back = np.unique(points, axis=0, return_inverse=True) if len(points) else (points, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(oddness(same, forest)[back.ravel()])], [*batch.schema.names, "oddness"])

    return stats.mapInArrow(run, ", ".join(["doc_id long", *(f"{x} long" for x in NAMES), "oddness double"]))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The oddness above which documents go, from all rows with labels; infinite without bad ones."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null and doc_id is not null")
    step = F.floor(F.col("oddness") * STEPS).cast("int").alias("step")
    table = scored.select("doc_id", step).join(known, "doc_id").groupBy("step").agg(F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") != 0).cast("long")).alias("good")).collect()
    bad, good = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for row in table:  # a row for each step at most
        bad[row.step], good[row.step] = row.bad, row.good
    if not bad.sum():
        return float("inf")
    above_bad, above_good = (np.append(x[::-1].cumsum()[::-1][1:], 0) / max(x.sum(), 1) for x in (bad, good))
    gain = above_bad - GOOD * above_good
    best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
    return float("inf") if gain[best] <= 0 else (best + 1) / STEPS


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, NAMES, oddness, base_failed, kept for each document.

    base_failed: under 50 words, or over half of the words in repeated windows
    of three words. Null and empty texts have no words and fail. Rows that
    repeat are each judged alike. Without documents there is nothing to judge;
    without labels of bad documents only the base rule rejects.
    """
    stats = kept(statistics(docs), "statistics")
    drawn = least_hashed(stats, TREES * LEAVES, SEED, *NAMES).select(*NAMES).toPandas()  # LEAVES rows of counts for each tree
    forest = grow(shares(drawn.to_numpy(np.int64).reshape(-1, len(NAMES)))[:, RULES])
    scored = kept(_scored(stats, forest), "scored")
    limit = threshold(scored, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = (F.col("oddness") * STEPS < limit * STEPS) if np.isfinite(limit) else F.lit(True)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


