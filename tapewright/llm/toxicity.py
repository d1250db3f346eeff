"""Operator 10, toxicity: multiple-instance learning over sentences.

A sentence's score is the logistic of a bias and of the weights of its words;
a document's is their noisy-or, one less the product of what they leave.
Weights are learned from labels of documents alone. The labelled rows are at
most LABELLED, those with the least hashes; their words are counted by label
in Spark, the WORDS that tell most are the vocabulary, and of a sentence only
words of the vocabulary come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import document_text, fold, kept, least_hashed

LABELLED, WORDS, SEED = 40_000, 2048, 5
#: A word of the vocabulary is in LEAST labelled documents, of which more are toxic than chance gives, by LIFT standard deviations.
LEAST, LIFT = 3, 4.5
STEPS, RATE, DECAY, START = 800, 0.05, 5e-6, -7.0
#: A sentence is named as offending from this score on.
OFFENDS = 0.3

_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def sentence_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence) of each word, then (text, first byte, last byte) of each sentence, and n sentences of each text.

    Words lose marks at both ends and are in lower case. A sentence ends with a
    word that ends in . ! or ?, at a new line and with the text.
    """
    lowered = spans.LOWER[data]
    starts, ends, n = spans.words(lowered, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none, np.zeros(len(at) - 1, np.int64)
    text = np.repeat(np.arange(len(n)), n)
    lines = np.cumsum(data == 10)
    stop = _ENDS[data[ends - 1]]
    stop[:-1] |= (lines[starts[1:]] != lines[starts[:-1]]) | (text[1:] != text[:-1])
    sentence = np.concatenate([[0], np.cumsum(stop[:-1])])
    a, b = starts.copy(), ends.copy()
    open_ = np.ones(len(a), bool)
    while open_.any():
        open_ &= (b - a > 1) & _MARK[data[b - 1]]
        b[open_] -= 1
    open_ = np.ones(len(a), bool)
    while open_.any():
        open_ &= (b - a > 1) & _MARK[data[a]]
        a[open_] += 1
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    return spans.hashes(lowered, a, b), sentence, text[first], starts[first], ends[last], np.bincount(text[first], minlength=len(n))


def _train_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        y = batch["y"].to_numpy()
        for first, last, data, at in spans.chunks(batch["text"]):
            h, sentence, text, _, _, n = sentence_words(data, at)
            base = np.cumsum(n) - n
            counts = np.bincount(text[sentence], minlength=last - first) if len(h) else np.zeros(last - first, np.int64)
            cut = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            within = (sentence - base[text[sentence]]).astype(np.int32) if len(h) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid + np.arange(last - first)), pa.array(y[first:last]), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(within))],
                ["rid", "y", "n", "words", "sentence"],
            )
            rid += last - first


class NoisyOr:
    """Word hashes (sorted), their weights and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.words, self.weights, self.bias = words, weights, bias

    def sums(self, h: np.ndarray, sentence: np.ndarray, sentences: int) -> np.ndarray:
        u = np.full(sentences, self.bias)
        if len(self.words) and len(h):
            where = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = np.flatnonzero(self.words[where] == h)
            # A word counts once in a sentence.
            once = np.unique(sentence[hit].astype(np.int64) * len(self.words) + where[hit])
            u += np.bincount(once // len(self.words), self.weights[once % len(self.words)], sentences)
        return u


def learn(words: np.ndarray, y: np.ndarray, sentences: np.ndarray, hit_doc: np.ndarray, hit_sentence: np.ndarray, hit_word: np.ndarray) -> NoisyOr:
    """Gradient steps on the documents' log-likelihood.

    sentences: how many each document has. hit_*: a row for each word of the
    vocabulary in each sentence; sentences are numbered over all documents.
    """
    weights, bias = np.zeros(len(words)), START
    moving, squares = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(weights, bias, y, sentences, hit_doc, hit_sentence, hit_word)
        moving, squares = 0.9 * moving + 0.1 * grad, 0.999 * squares + 0.001 * grad**2
        move = RATE * (moving / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], min(bias - move[-1], -1.0)
    return NoisyOr(words, weights, bias)


def loss_and_gradient(weights: np.ndarray, bias: float, y: np.ndarray, sentences: np.ndarray, hit_doc: np.ndarray, hit_sentence: np.ndarray, hit_word: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of the documents with the weights' decay, and its slope along each weight and the bias."""
    n = max(len(y), 1)
    of_sentence = np.zeros(int(hit_sentence.max()) + 1 if len(hit_sentence) else 0, np.int64)
    of_sentence[hit_sentence] = hit_doc
    plain = sentences - np.bincount(of_sentence, minlength=len(y))[: len(y)]  # sentences without a word of the vocabulary
    u = bias + np.bincount(hit_sentence, weights[hit_word], len(of_sentence))
    total = np.bincount(of_sentence, np.logaddexp(0, u), len(y)) + plain * np.logaddexp(0, bias)
    slope = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
    by_sentence = slope[of_sentence] / (1 + np.exp(-u))
    grad = np.append(np.bincount(hit_word, by_sentence[hit_sentence], len(weights)), by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-bias))) / n
    grad[:-1] += DECAY * weights
    loss = np.where(y == 1, -np.log(-np.expm1(-np.maximum(total, 1e-9))), total).sum() / n + DECAY / 2 * (weights**2).sum()
    return float(loss), grad


def fit(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(fold(5) != 0)
    sample = least_hashed(known, LABELLED, SEED)
    rows = document_text(docs).join(F.broadcast(sample), "doc_id").select("text", "y")  # LABELLED rows at most are sent
    train = kept(rows.mapInArrow(_train_words, "rid long, y int, n long, words array<long>, sentence array<int>"), "labelled")
    totals = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    if not totals.n or not totals.bad:
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    share = totals.bad / totals.n
    seen = train.select("y", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).where(F.col("n") >= LEAST)
    lift = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = np.sort(np.array([r.word for r in seen.withColumn("lift", lift).where(F.col("lift") >= LIFT).orderBy(F.desc("lift"), "word").limit(WORDS).select("word").collect()], np.int64).view(np.uint64))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["words"].value_lengths().to_numpy()
            h, sentence = batch["words"].flatten().to_numpy().view(np.uint64), batch["sentence"].flatten().to_numpy()
            where = np.minimum(np.searchsorted(chosen, h), max(len(chosen) - 1, 0))
            hit = chosen[where] == h if len(chosen) else np.zeros(len(h), bool)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(lengths)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["y"], batch["n"], pa.ListArray.from_arrays(cut, pa.array(where[hit].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(sentence[hit]))], ["rid", "y", "n", "word", "sentence"])

    got = train.mapInArrow(hits, "rid long, y int, n long, word array<int>, sentence array<int>").orderBy("rid").toArrow()  # LABELLED rows at most
    n = got["n"].to_numpy()
    word, within = got["word"].combine_chunks(), got["sentence"].combine_chunks()
    owner = np.repeat(np.arange(len(n)), word.value_lengths().to_numpy())
    key = (np.cumsum(n) - n)[owner] + within.flatten().to_numpy()
    _, packed = np.unique(key, return_inverse=True)
    once = np.unique(np.stack([packed, word.flatten().to_numpy(), owner]), axis=1) if len(owner) else np.zeros((3, 0), np.int64)
    return learn(chosen, got["y"].to_numpy(), n, once[2], once[0], once[1])


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for each document.

    offending: the sentences scored OFFENDS or more, as (first byte, byte after
    the last, score). A text without words scores 0. Without labels of toxic
    documents every score is near 0. Labels of held-out rows are never used.
    Rows that repeat are each scored alike, and labels that repeat each count;
    null ids are scored and have no labels.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for first, last, data, at in spans.chunks(batch["text"]):
                h, sentence, text, begin, end, n = sentence_words(data, at)
                u = model.sums(h, sentence, len(text))
                score = -np.expm1(-np.bincount(text, np.logaddexp(0, u), last - first))
                own = 1 / (1 + np.exp(-u))
                bad = np.flatnonzero(own >= OFFENDS)
                cut_at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[bad], minlength=last - first))]).astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(begin[bad] - at[text[bad]], pa.int64()), pa.array(end[bad] - at[text[bad]], pa.int64()), pa.array(own[bad])], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(score), pa.ListArray.from_arrays(cut_at, found)], ["doc_id", "score", "offending"])

    scored = document_text(docs).mapInArrow(run, "doc_id long, score double, offending array<struct<first:long,last:long,score:double>>")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "offending")
