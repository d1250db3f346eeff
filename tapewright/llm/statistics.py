"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm import spans
from tapewright.llm.common import document_text

#: Classes of bytes; 0: anything else.
SPACE, NEWLINE, SYMBOL, UPPER, LOWER, DIGIT, STOP, SHOUT, MORE = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 9, 11, 12, 13]] = SPACE
_CLASS[10] = NEWLINE
_CLASS[list(b"#*$%&|<>")] = SYMBOL
_CLASS[65:91] = UPPER
_CLASS[97:123] = LOWER
_CLASS[48:58] = DIGIT
_CLASS[list(b".,;:")] = STOP
_CLASS[list(b"!?")] = SHOUT
_CLASS[0x80:0xC0] = MORE  # the bytes of a character after its first

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_code_points", "n_upper", "n_lower", "n_digits", "n_stops", "n_shouts", "n_newlines", "n_distinct_words", "n_lines_with_words")
WINDOW = 3


def _within(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values of the same text."""
    return spans.mixed(values + np.repeat(np.arange(len(n), dtype=np.uint64) * spans._PLACES[6], n))


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    texts, sizes = len(at) - 1, np.diff(at)
    by_class = np.bincount(np.repeat(np.arange(texts) * 16, sizes) + _CLASS[data], minlength=texts * 16).reshape(texts, 16)
    points = sizes - by_class[:, MORE]
    starts, ends, n = spans.words(data, at)
    hashed = spans.hashes(data, starts, ends)

    windows, per = spans.shingles(hashed, n, WINDOW)
    per_whole = np.maximum(n - WINDOW + 1, 0)
    windows, per = windows[np.repeat(n >= WINDOW, per)], per_whole  # a short text has no window
    _, back, times = np.unique(_within(windows, per), return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashed) + WINDOW, bool)
    first_word = np.cumsum(n) - n
    place = np.repeat(first_word - (np.cumsum(per) - per), per) + np.arange(len(windows))
    again = place[times[back] > 1]
    for j in range(WINDOW):
        covered[again + j] = True
    text_of_word = np.repeat(np.arange(texts), n)
    repeat_words = np.bincount(text_of_word[covered[: len(hashed)]], minlength=texts)
    own = np.unique(_within(hashed, n), return_index=True)[1]
    distinct = np.bincount(text_of_word[own], minlength=texts)

    dup, lined = np.zeros(texts, np.int64), np.minimum(n, 1).astype(np.int64)
    whole, edges = data.tobytes(), at.tolist()
    for i in np.flatnonzero(by_class[:, NEWLINE]).tolist():
        lines = [x for x in whole[edges[i] : edges[i + 1]].split(b"\n") if x.strip()]
        dup[i], lined[i] = len(lines) - len(set(lines)), len(lines)
    return np.stack(
        [n, points - by_class[:, SPACE] - by_class[:, NEWLINE], by_class[:, SYMBOL], dup, repeat_words, points, by_class[:, UPPER], by_class[:, LOWER], by_class[:, DIGIT], by_class[:, STOP], by_class[:, SHOUT], by_class[:, NEWLINE], distinct, lined], axis=1
    ).astype(np.int64)


def shares(c: np.ndarray) -> np.ndarray:
    """Statistics that don't grow with the length of a text, from rows of NAMES."""
    c = c.astype(np.float64)
    get = dict(zip(NAMES, c.T, strict=True))
    words, points, letters = np.maximum(get["n_words"], 1), np.maximum(get["n_code_points"], 1), np.maximum(get["n_upper"] + get["n_lower"], 1)
    lines = np.maximum(get["n_lines_with_words"], 1)
    return np.stack(
        [
            np.sqrt(get["n_symbols"] / points),
            np.sqrt(get["n_upper"] / letters),
            np.sqrt(get["n_shouts"] / points),
            np.sqrt(get["n_stops"] / points),
            np.sqrt(get["n_digits"] / points),
            np.log(np.maximum(get["word_chars"], 1) / words),
            np.sqrt(get["n_repeat_words"] / words),
            np.sqrt(get["n_dup_lines"] / lines),
            np.minimum(get["n_symbols"] / words, 4.0),
            np.minimum(get["n_shouts"] / words, 4.0),
            np.log1p(get["n_distinct_words"]) / np.log1p(words),
            np.log1p(words / lines),
        ],
        axis=1,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and NAMES for each document; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in spans.chunks(batch["text"]):
                found = counts(data, at)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), *(pa.array(x) for x in found.T)], ["doc_id", *NAMES])

    return document_text(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{x} long" for x in NAMES)]))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[x].to_numpy(zero_copy_only=False) for x in NAMES], axis=1)
