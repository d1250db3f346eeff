"""Operator 11, hard-negative mining: a vertical scan that narrows by bounds.

Rows are dealt by hash into blocks that hold a matrix laid out by dimension,
with each dimension's least and greatest value. An anchor reads the dimensions
in descending order of its own magnitudes; after each few of them, what the
rest can still add, at least and at most, takes rows off the bitmap of those
that may matter. The first scan finds each anchor's positives, the second, whose
windows follow from their scores, the negatives. What a block finds for an
anchor is a handful of rows; those are merged in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import kept

#: Values in the matrix of a block, of rows or of anchors; dimensions that are read between two looks at the bounds.
VALUES, STEP = 1 << 19, 8
#: Integers are exact in doubles up to here.
EXACT = 2.0**53
_LONG = (1 << 63) - 1


class Block:
    """Rows of quantised vectors by dimension, sorted by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): rows that `narrow(at least, at most)` left, with their exact scores."""
        columns, low, high = self.columns, self.low, self.high
        if float(np.abs(anchor) @ self.most) >= EXACT:  # Python's integers: slow and exact
            whole = np.frompyfunc(int, 1, 1)
            anchor, columns, low, high = whole(anchor), whole(columns), whole(low), whole(high)
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        ends = np.stack([anchor * low, anchor * high])[:, order]
        rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
        least, most = rest(ends.min(axis=0)), rest(ends.max(axis=0))
        scores = np.zeros(len(alive), columns.dtype)
        for k in range(0, len(order), STEP):
            read = order[k : k + STEP]
            scores = scores + anchor[read] @ (columns[read] if len(alive) == columns.shape[1] else columns[np.ix_(read, alive)])
            after = min(k + STEP, len(order))
            stay = narrow(scores + least[after], scores + most[after])
            if not stay.all():
                alive, scores = alive[stay], scores[stay]
            if not len(alive):
                break
        return alive, scores

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places of the first n by score, then id."""
        return np.lexsort((self.ids[rows], -scores))[:n]


def _greatest(x: np.ndarray, n: int):
    return np.partition(x, len(x) - n)[len(x) - n] if x.dtype != object else np.sort(x)[len(x) - n]


def _positives(block: Block, anchor: np.ndarray, vec_id: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the first n other rows of the label in this block."""
    a, b = block.of_label(label)
    rows = np.arange(a, b)
    own = (block.ids[a:b] == vec_id) & (block.columns[:, a:b] == anchor[:, None]).all(axis=0)
    rows = rows[~own]

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= _greatest(least, n) if len(least) > n else np.ones(len(least), bool)

    rows, scores = block.scan(anchor, rows, narrow)
    first = block.best(rows, scores, n)
    return rows[first], scores[first]


def _negatives(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (rows, scores) of the first n rows of other labels in it."""
    a, b = block.of_label(label)
    rows = np.concatenate([np.arange(a), np.arange(b, len(block.ids))])

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(least), bool)
        for low, high in windows:
            may = (most >= low) & (least <= high)
            inside = least[(least >= low) & (most <= high)]
            if len(inside) >= n:
                may &= most >= _greatest(inside, n)
            stay |= may
        return stay

    rows, scores = block.scan(anchor, rows, narrow)
    found = []
    for low, high in windows:
        at = np.flatnonzero((scores >= low) & (scores <= high))
        at = at[block.best(rows[at], scores[at], n)]
        found.append((rows[at], scores[at]))
    return found


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """floor(256 x), shorter vectors filled with zeros; magnitudes beyond 2**53 count as 2**53."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.clip(np.floor(256.0 * out), -EXACT, EXACT)


def _block(rows: pd.DataFrame, dims: int) -> Block:
    return Block(rows.vec_id.to_numpy(np.int64), rows.label.to_numpy(np.int64), _matrix(rows.embedding, dims))


def _longs(x: np.ndarray) -> list[int]:
    return [max(-_LONG, min(_LONG, int(v))) for v in x.tolist()]


def _first(df: DataFrame, keys: tuple[str, ...], score: str, vec_id: str, n: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and a hash of the row, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    fit = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return fit.withColumn("row", F.xxhash64("vec_id", "label", "embedding"))


def hard_negatives(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; `anchor` tells which rows are anchors.
    A negative's score is at least share[0]/share[1] of the positive's and at
    most the positive's. Rows without id, label or vector, or with a component
    that is null or not finite, take no part. Rows that repeat in id, label and
    vector count once; rows that share only the id count each. Shorter vectors
    are filled with zeros. Scores beyond a long's range become its end, and windows follow from those. An
    anchor without positives, and a positive without negatives, give no row; an
    empty table gives an empty one. Other columns are not looked at.

    Rows and anchors are dealt into blocks of a bounded size, by hash of the
    whole row, so that neither a common vector nor a label is a hot spot; each
    pair of a block of anchors and a block of rows is one task's work, as large
    at every size.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors)
    size = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims")).first()
    dims, bound = size.dims, max(1, VALUES // max(1, size.dims))
    n_rows, n_anchors = -(-max(1, size.n) // bound), -(-max(1, size.anchors) // bound)
    tasks = 2 * n_rows * n_anchors
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    keys = ("anchors", "rows")
    blocks = rows.withColumn("rows", dealt(n_rows)).withColumn("anchors", every(n_anchors)).repartition(tasks, *keys)

    def against(table: DataFrame) -> DataFrame:
        return table.withColumn("anchors", dealt(n_anchors)).withColumn("rows", every(n_rows)).repartition(tasks, *keys)

    def without_repeats(df: pd.DataFrame) -> pd.DataFrame:
        return df.drop_duplicates("row")

    def find_positives(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(others):
            block, anchors = _block(without_repeats(others), dims), without_repeats(anchors)
            for row, vec_id, label, vector in zip(anchors.row, anchors.vec_id, anchors.label, _matrix(anchors.embedding, dims), strict=True):
                at, scores = _positives(block, vector, vec_id, label, n_positives)
                out += [(row, i, s) for i, s in zip(block.ids[at].tolist(), _longs(scores), strict=True)]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_score"])

    low, whole = share

    def find_negatives(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(others):
            block = _block(without_repeats(others), dims)
            for row, label, ps, vector in zip(anchors.row, anchors.label, anchors.positives, _matrix(anchors.embedding, dims), strict=True):
                windows = [(-(-low * int(p["positive_score"]) // whole), int(p["positive_score"])) for p in ps]
                for place, (at, scores) in enumerate(_negatives(block, vector, label, windows, n_negatives)):
                    out += [(row, place, i, s) for i, s in zip(block.ids[at].tolist(), _longs(scores), strict=True)]
        return pd.DataFrame(out, columns=["row", "place", "negative_id", "negative_score"])

    anchors = rows.where(anchor)
    found = against(anchors).groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(find_positives, "row long, positive_id long, positive_score long")
    best = _first(found, ("row",), "positive_score", "positive_id", n_positives).groupBy("row")
    positives = best.agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asked = kept(anchors.dropDuplicates(["row"]).join(positives, "row"), "positives")

    met = against(asked).groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(find_negatives, "row long, place int, negative_id long, negative_score long")
    first = _first(met, ("row", "place"), "negative_score", "negative_id", n_negatives)
    named = first.join(asked.select("row", F.col("vec_id").alias("anchor_id"), "positives"), "row").withColumn("p", F.get("positives", F.col("place")))
    return named.select("anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "p.positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """The labels of the contract: where vec_id is divisible by 7, (label + 1) % 10."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
