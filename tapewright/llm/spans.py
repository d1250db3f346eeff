"""Words and their hashes for a batch of texts, in numpy.

All functions take the UTF-8 bytes of several texts laid end to end (`data`)
and the places where they begin and end (`at`, one more than there are texts).
Nothing here keeps more than a few arrays of the size of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Spans of more bytes are hashed one by one.
LONG = 128

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RADIX = U64(0x100000001B3)
#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, at) for runs of rows of about `most` bytes; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, bytes_ = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n): the words of all texts in order, and how many each text has."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends_at = at[1:][at[1:] > 0] - 1
    after[ends_at] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    lengths = ends - starts
    out = np.zeros(len(lengths), U64)
    long = np.flatnonzero(lengths > LONG)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    order = np.argsort(np.where(lengths > LONG, 0, lengths).astype(np.uint16), kind="stable")[::-1]
    order = order[: len(order) - len(long)]
    first, length = starts[order], lengths[order]
    h = np.zeros(len(order), U64)
    counts = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for k, m in enumerate(counts.tolist()):
        h[:m] = (h[:m] ^ data[first[:m] + k]) * _RADIX
        if k & 7 == 7:
            h[:m] ^= h[:m] >> U64(29)
    out[order] = h
    return mixed(out + lengths.astype(U64) * _PLACES[0])


def shingles(word_hashes: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n): the shingles of `width` words of all texts in order, and how many each text has.

    A text with fewer words, but any, has one shingle: all its words.
    """
    total = len(word_hashes)
    if not total:
        return np.zeros(0, U64), np.zeros(len(n), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    padded, owner = np.concatenate([word_hashes, np.zeros(width - 1, U64)]), np.concatenate([text, np.full(width - 1, -1)])
    whole = owner[width - 1 :] == text
    short = np.zeros(total, bool)
    begins = np.cumsum(n) - n
    short[begins[(n > 0) & (n < width)]] = True
    out = word_hashes * _PLACES[0]
    for j in range(1, width):
        out += np.where(owner[j : j + total] == text, padded[j : j + total], U64(0)) * _PLACES[j]
    keep = whole | short
    return mixed(out[keep]), np.bincount(text[keep], minlength=len(n))


def shingle_sets(texts: pa.Array, width: int, lower: bool = True) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) chunk by chunk."""
    for first, _, data, at in chunks(texts):
        data = LOWER[data] if lower else data
        starts, ends, n = words(data, at)
        found, count = shingles(hashes(data, starts, ends), n, width)
        cut = np.concatenate([[0], np.cumsum(count)])
        yield first, [np.unique(found[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
