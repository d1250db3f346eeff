"""Subword ids of many texts with the tokenizers library.

Byte-level BPE never merges over the single space before a word, nor over the
end of a run of letters before a mark. So texts are cut there, and each distinct piece is encoded once in the life of a worker:
pieces that are new go to the library in long runs, and its ids are dealt back
to the pieces by the number of bytes each id stands for.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tapewright.llm import spans

DEFAULT = "byte_bpe_50k.json"
#: Pieces a worker remembers; about 40 bytes each, and twice that while new ones come in.
REMEMBER = 500_000
RUN_BYTES = 16_384


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def _safe_sides() -> tuple[np.ndarray, np.ndarray]:
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = True
    ahead = plain.copy()
    ahead[0x80:] = True
    ahead[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # these bytes begin the other white space of Unicode
    return plain, ahead


_PLAIN, _AHEAD = _safe_sides()
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b",.;:!?")] = True


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n): the pieces of all texts; they begin at single spaces between characters that aren't white space, and at marks after an ASCII letter."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        space = np.flatnonzero(data[1:-1] == 0x20) + 1
        before, odd = data[space - 1], np.zeros(len(space), bool)
        odd |= data[np.maximum(space - 2, 0)] == 0xC2
        odd |= np.isin(data[np.maximum(space - 3, 0)], (0xE1, 0xE2, 0xE3))
        good = (_PLAIN[before] | ((before >= 0x80) & ~odd)) & _AHEAD[data[space + 1]]
        cut[space[good]] = True
        cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[at] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    return starts, ends[: len(starts)], np.diff(np.searchsorted(starts, at))


class Subwords:
    """Encoder with a memory; one for each worker and file."""

    _of: dict[str, Subwords] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        # Byte-level vocabularies write each byte as one character.
        self.bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # pieces met again since they came in or were last sifted

    def sift(self, new: int) -> None:
        """Makes room for `new` pieces: those that weren't met again go; all, if that is not enough."""
        kept = np.flatnonzero(self.again)
        if len(kept) > REMEMBER // 2 or len(kept) + new > REMEMBER:
            self.forget()
            return
        self.ids, count = self.laid_out(self.first[kept], self.count[kept]), self.count[kept]
        self.known, self.first, self.count, self.again = self.known[kept], np.cumsum(count) - count, count, np.zeros(len(kept), bool)

    @classmethod
    def at(cls, path: str) -> Subwords:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        total = int(size.sum())
        laid = np.cumsum(size) - size
        flat = data[np.repeat(starts - laid, size) + np.arange(total)].tobytes()
        # Runs of whole pieces. Two pieces may meet so that they would merge unless the second begins with a plain space.
        joins = (data[starts] == 0x20) & _AHEAD[data[np.minimum(starts + 1, len(data) - 1)]] & (size > 1)
        last = data[ends - 1]
        joins[1:] &= _PLAIN[last[:-1]] | ((last[:-1] >= 0x80) & ~np.isin(data[np.maximum(ends[:-1] - 2, 0)], (0xC2,)) & ~np.isin(data[np.maximum(ends[:-1] - 3, 0)], (0xE1, 0xE2, 0xE3)))
        begin = ~joins
        begin[:1] = True
        at, since = laid.tolist(), 0
        for i, new in enumerate(begin.tolist()):  # a run ends before it gets long, too
            if new or at[i] - since > RUN_BYTES:
                begin[i], since = True, at[i]
        edges = [*laid[begin].tolist(), total]
        found = self.library.encode_batch_fast([flat[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)
        begins = np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]
        first = np.searchsorted(begins, laid)
        count = np.diff(np.append(first, len(ids)))
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        where = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, where, keys)
        self.first = np.insert(self.first, where, first + base)
        self.count = np.insert(self.count, where, count)
        self.again = np.insert(self.again, where, False)

    def of_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, back, first, count): the distinct pieces' hashes, which of them each piece is, and where in `ids` those of each begin and how many they are."""
        keys, one, back = np.unique(spans.hashes(data, starts, ends), return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[where] != keys if len(self.known) else np.ones(len(keys), bool)
        self.again[where[~new]] = True
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBER:
                self.sift(int(new.sum()))
                new = ~np.isin(keys, self.known, assume_unique=True)
            self._learn(keys[new], data, starts[one[new]], ends[one[new]])
            where = np.searchsorted(self.known, keys)
        return keys, back, self.first[where], self.count[where]

    def laid_out(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids that begin at each `first`, `count` of each, end to end."""
        laid = np.cumsum(count) - count
        return self.ids[np.repeat(first - laid, count) + np.arange(int(count.sum()))]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): the ids of all texts, and how many each text has."""
        starts, ends, n = pieces(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), n
        _, back, first, count = self.of_pieces(data, starts, ends)
        count = count[back]
        total = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n)])]
        return self.laid_out(first[back], count), np.diff(total)


def encoded(texts: pa.Array, path: str, most: int = 8 << 20):
    """(first row, ids, n) chunk by chunk."""
    own = Subwords.at(path)
    for first, _, data, at in spans.chunks(texts, most):
        yield (first, *own.encode(data, at))
