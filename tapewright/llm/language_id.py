"""Operator 13, language identification: string kernels with landmarks.

A text's features are the presence of byte n-grams of one to three bytes, of
all its letters, dealt into BUCKETS; two texts' kernel is the number of shared
buckets over the geometric mean of theirs. Labelled texts are compared with
LANDMARKS of them, and the kernel of those with one another turns this into
coordinates; a ridge regression for each language separates it from the rest.
Texts are scored in batches by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import document_text, fold, kept, quoted

BUCKETS, WIDTHS, BATCH = 1 << 14, (1, 2, 3), 256
#: Labelled texts that the regressions are fitted on, dealt evenly over languages; those of them that are landmarks.
FIT, LANDMARKS, SEED = 4_000, 160, 13
RIDGE, FLOOR = 1e-3, 1e-6
#: A table of at most so many languages is sent to all tasks.
SMALL = 10_000

#: Bytes that aren't letters are all one; A-Z are lower case, bytes of other characters as they are.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BUCKETS for each text: 1 where one of its n-grams falls. N-grams don't cross texts."""
    texts, sizes = len(at) - 1, np.diff(at)
    out = np.zeros((texts, BUCKETS), np.float32)
    code = _LETTER[data].astype(np.uint32)
    text = np.repeat(np.arange(texts, dtype=np.int32), sizes)
    grams = np.zeros(len(code), np.uint32)
    for k in WIDTHS:
        n = len(code) - k + 1
        if n <= 0:
            break
        grams = grams[:n] * np.uint32(256) + code[k - 1 :]
        bucket = ((grams + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 14)
        whole = text[:n] == text[k - 1 :]
        out[text[:n][whole], bucket[whole]] = 1
    return out


def _batches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of at most BATCH texts."""
    for first, last, data, at in spans.chunks(texts):
        for k in range(0, last - first, BATCH):
            edge = at[k : min(k + BATCH, last - first) + 1]
            yield first + k, first + k + len(edge) - 1, data[edge[0] : edge[-1]], edge - edge[0]


class Languages:
    """Fitted from rows of packed presence bits and their languages."""

    def __init__(self, bits: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        if not self.names:
            return
        y = np.array([self.names.index(x) for x in langs])
        x = np.unpackbits(bits, axis=1).astype(np.float32)
        # Landmarks: the first of each language in turn.
        turn = np.zeros(len(y), int)
        for k in range(len(self.names)):
            turn[y == k] = np.arange((y == k).sum())
        self.marks = x[np.lexsort((y, turn))[:LANDMARKS]]
        self.root = np.sqrt(np.maximum(self.marks.sum(axis=1), 1))
        values, vectors = np.linalg.eigh(self._kernel(self.marks).astype(np.float64))
        fine = values > FLOOR * max(values[-1], FLOOR)
        self.project = (vectors[:, fine] / np.sqrt(values[fine])).astype(np.float32)
        z = self._place(x).astype(np.float64)
        z = np.hstack([z, np.ones((len(z), 1))])
        weight = 1 / np.bincount(y)[y] / len(self.names)  # languages count alike
        target = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        gram = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
        self.weights = np.linalg.solve(gram, (z * weight[:, None]).T @ target).astype(np.float32)

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * self.root)

    def _place(self, x: np.ndarray) -> np.ndarray:
        z = self._kernel(x) @ self.project
        return z / np.maximum(np.sqrt((z**2).sum(axis=1, keepdims=True)), 1e-12)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in names, score from 0 to 1: half of one more than the regression's value)."""
        found = self._place(x) @ self.weights[:-1] + self.weights[-1]
        best = found.argmax(axis=1)
        return best, np.clip((found[np.arange(len(x)), best].astype(np.float64) + 1) / 2, 0, 1)


def fit(docs: DataFrame) -> Languages:
    """docs: doc_id, text, lang, of labelled rows. At most FIT rows, of BUCKETS bits each, come to the driver."""
    hashed = F.xxhash64("doc_id", "text", F.lit(SEED))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", hashed)
    # Only hashes under the one that about FIT and six deviations of the language's rows have are sent to be ordered.
    sizes = kept(known.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    below = F.least(F.lit(1.0), (FIT + 6 * FIT**0.5 + 1) / F.col("size"))
    near = known.join(sizes, "lang").where(F.col("h") / 2.0**64 + 0.5 <= below)
    turn = near.withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("turn") <= FIT)
    taken = turn.orderBy("turn", F.xxhash64("lang", F.lit(SEED)), "lang").limit(FIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in _batches(batch["text"]):
                bits = np.packbits(presence(data, at).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(first, last - first), pa.array([b.tobytes() for b in bits])], ["lang", "bits"])

    rows = taken.select("lang", "text").mapInArrow(run, "lang string, bits binary").toPandas()
    bits = np.stack([np.frombuffer(b, np.uint8) for b in rows.bits]) if len(rows) else np.zeros((0, BUCKETS // 8), np.uint8)
    return Languages(bits, rows.lang.tolist())


def language_id(docs: DataFrame, held: int = 1, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document.

    Learned from text and language of the rows whose crc32(doc_id) modulo
    `modulus` isn't `held`. A text that is null or has no letter is `und` with
    score 0; without a labelled text with letters all are. Of texts whose
    scores tie, the first language by code point is taken. Rows that repeat are
    each predicted, alike; null ids count as an empty id. An empty table gives
    an empty one.
    """
    own = document_text(docs).select("doc_id", "text")
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(quoted("lang")).cast("string").alias("lang"))
    model = fit(learn.where(fold(modulus) != held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in _batches(batch["text"]):
                n = last - first
                named, score = (np.full(n, "und", object), np.zeros(n))
                spoken = batch["letters"].slice(first, n).to_numpy(zero_copy_only=False).astype(bool)
                if model.names and spoken.any():
                    best, certain = model.predict(presence(data, at))
                    named = np.where(spoken, np.array(model.names, object)[best], named)
                    score = np.where(spoken, certain, 0.0)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    marked = own.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", (fold(modulus) == held).alias("held_out"), "lang_pred", "score")
