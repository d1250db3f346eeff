"""Operator 6, language-model scoring.

A causal self-attention model over subword ids, in numpy. It predicts the class
of the next id from the ids before it, and the id by its share in the class
(a softmax of two levels: 50,000 outputs for each id would cost a thousand
times as much). Each text ends with an id of its own, END, which also stands
before a text; it is learned and scored like all others. `score` is the sum of
this model's log10 probabilities over a text's ids and its end, nothing else.

Every text is encoded once; its ids are kept beside it until they are scored.
Ids are counted over all training documents. The attention model and the
classes learn from all of them, too: every id of every training text, and its
end, is in a window of its text once, with those before it. The texts are dealt
by hash to ROUNDS rounds, and in a round into slots of about SLOT windows; each
slot's task trains from the same weights over its windows of the round, and
Spark averages what the slots found: one row for each weight, however many slots
there are, reaches the driver.
Nothing of this depends on how rows lie in partitions. Scoring goes over
windows of WINDOW ids that overlap by WINDOW - STRIDE; each id is scored once,
with those before it in its window.

Beside it stands the plain word model (`base_score`): counts of all words of
all training documents, smoothed by a half. Its most frequent HEAD words are
sent to the tasks; the other words of each document are joined to the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import arrow_batches, document_text, fold, kept, partitions, remove_kept
from tapewright.llm.packing import with_end
from tapewright.llm.subwords import Subwords, default_path, encoded

HEAD = 131_072
PASSED = 4 << 20  # bytes of a batch of Arrow
SEED = 23
BLOCK, SLOT, ROUNDS, NEAR = 1 << 40, 51_200, 4, 64  # a text is one block: each of its ids is learned
WINDOW, STRIDE, WIDTH, CLASSES, SINGLE = 20, 15, 12, 48, 8
STEPS, BATCH, RATE = 400, 128, 0.01  # steps: of each slot in all rounds, at least; a small corpus is gone over more often
END_KEY = 0  # of the end among the words; no word has it but by a chance of 2^-64
END_CLASS = 0  # the end is a class of its own, and what stands before a text
BOUND = 40.0  # of what is exponentiated without its maximum taken off
FIXED = float(1 << 24)  # weights are summed over slots as whole numbers of this part, in any order alike


class Attention:
    """One head, one layer: class of the next id from the classes of the ids before it."""

    def __init__(self, classes: np.ndarray, share: np.ndarray, seed: int = SEED) -> None:
        """classes: of each id; share: log of each id's share in its class."""
        self.classes, self.share = classes.astype(np.int32), share.astype(np.float32)
        rng = np.random.default_rng(seed)
        d = WIDTH
        shapes = {"embed": (CLASSES, d), "place": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "out": (d, CLASSES), "bias": (CLASSES,)}
        self.p = {k: (rng.normal(0, 0.3, s) if k != "bias" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mask = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)
        self.before = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.work: dict[str, np.ndarray] = {}

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """x: rows of classes; the class before a text is END_CLASS."""
        p = self.p
        h = p["embed"][x] + p["place"][: x.shape[1]]
        q, k, v = h @ p["q"], h @ p["k"], h @ p["v"]
        a = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + self.mask[: x.shape[1], : x.shape[1]]
        a = np.exp(a - a.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        m = a @ v
        r = h + m @ p["o"]
        t = np.tanh(r)
        z = t @ p["out"] + p["bias"]
        z -= z.max(axis=2, keepdims=True)
        return {"h": h, "q": q, "k": k, "v": v, "a": a, "m": m, "t": t, "z": z - np.log(np.exp(z).sum(axis=2, keepdims=True))}

    def gradients(self, x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of y after x, both rows of classes; the class before a text is END_CLASS. use: the places of y that count; all, if not given."""
        p, d, n, t, real = self.p, WIDTH, y.size, x.shape[1], self.p["out"].dtype
        parts, outs, mild, (pair, pass_on) = self._parts()
        f = np.take(parts[:CLASSES], x, axis=0, out=self._held("f", *x.shape, parts.shape[1]), mode="clip")
        flat = f.reshape(len(x), -1)
        flat += parts[CLASSES : CLASSES + t].ravel()
        q, h, v = (f[:, :, i * d : (i + 1) * d] for i in range(3))
        before = self.before[:t, :t]
        a = np.matmul(q, h.transpose(0, 2, 1), out=self._held("a", len(x), t, t))
        if not mild[0]:
            a -= np.where(before > 0, a, -np.inf).max(axis=2, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= before
        a *= (1 / (a.reshape(-1, t) @ np.ones(t, real))).reshape(-1, t, 1)
        m = np.matmul(a, v, out=self._held("m", len(x), t, d)).reshape(-1, d)
        o = m + h.reshape(-1, d)
        _tanh(o)
        u = self._held("u", n, d + 1)  # with a one, which takes the bias
        u[:, :d], u[:, d] = o, 1
        z = np.matmul(u, outs, out=self._held("z", n, CLASSES))
        if not mild[1]:
            z -= z.max(axis=1, keepdims=True)
        own = np.arange(n) * CLASSES + y.ravel()
        picked = z.ravel()[own]
        np.exp(z, out=z)
        total = z @ np.ones(CLASSES, real)
        loss, weight = np.log(total) - picked, real.type(1 / n) / total
        if use is not None:
            some = use.ravel()
            loss, weight = loss[some], np.where(some, real.type(1 / some.sum()) / total, real.type(0))
        z.ravel()[own] -= total  # with `weight` before each row: the gradient of z; narrow arrays are weighed, not this one
        both = (u * weight[:, None]).T @ z
        dr = z @ p["out"].T
        np.square(o, out=o)
        np.subtract(1, o, out=o)
        o *= weight[:, None]
        dr *= o
        # A weight's gradient is that of its share of the mean less that of the mean itself: dr times (value - mean).
        less = self._held("less", n, d + 1)
        less[:, :d], less[:, d] = dr, -((dr * m) @ np.ones(d, real))
        ds = np.matmul(less.reshape(len(x), t, d + 1), f[:, :, 2 * d :].transpose(0, 2, 1), out=self._held("ds", len(x), t, t))
        ds *= a
        # Of pairs and of what is passed on, then of the four matrices these are products of, then of the sums of embeddings.
        own, flat = self._held("own", 3, len(x), t, d), h.reshape(-1, d)
        np.matmul(ds, h, out=own[0])
        np.matmul(a.transpose(0, 2, 1), dr.reshape(h.shape), out=own[1])
        np.matmul(ds.transpose(0, 2, 1), q, out=own[2])
        left, right, dh = own.reshape(3, -1, d)
        of_pair, of_pass = real.type(d**-0.5) * (flat.T @ left), flat.T @ right
        g = {"out": both[:d], "bias": both[d], "q": of_pair @ p["k"], "k": of_pair.T @ p["q"], "v": of_pass @ p["o"].T, "o": p["v"].T @ of_pass}
        dh += dr
        dh += left @ pair.T
        dh += right @ pass_on.T
        g["place"] = np.zeros_like(p["place"])
        g["place"][:t] = dh.reshape(-1, t * d).sum(axis=0).reshape(t, d)
        many, order = np.bincount(x.ravel(), minlength=CLASSES), np.argsort(x.ravel().astype(np.uint8), kind="stable")
        there = np.flatnonzero(many)
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][there] = np.add.reduceat(np.take(dh, order, axis=0), (np.cumsum(many) - many)[there], axis=0)
        return float(loss.mean()), g

    def _held(self, name: str, *shape: int) -> np.ndarray:
        """An array to be written over, the same one from step to step: new ones of this size cost more than the sums."""
        real = self.p["out"].dtype
        if name not in self.work or self.work[name].shape != shape or self.work[name].dtype != real:
            self.work[name] = np.empty(shape, real)
        return self.work[name]

    def train(self, rows: np.ndarray, done: float = 0.0, part: float = 1.0, seed: int = SEED) -> float:
        """rows: windows as _windows makes them, in classes; done, part: what share of the training lies behind, and what share this is. The last loss."""
        rng, loss, names, shapes = np.random.default_rng(seed), 0.0, list(self.p), [v.shape for v in self.p.values()]
        flat = np.concatenate([v.ravel() for v in self.p.values()])  # all weights move at once; each is a view of them
        self.p = {k: v.reshape(s) for k, s, v in zip(names, shapes, np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1]), strict=True)}
        m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
        steps = max(round(STEPS * part), -(-len(rows) // BATCH)) if len(rows) else 0
        order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * BATCH // max(len(rows), 1)))]) if steps else None
        for step in range(1, steps + 1):
            taken = rows[order[(step - 1) * BATCH : step * BATCH]]
            use = taken[:, 1:] >= 0
            loss, found = self.gradients(np.maximum(taken[:, :-1], 0), np.maximum(taken[:, 1:], 0), None if use.all() else use)
            rate = RATE * min(1.0, 4 * (1 - (done + part * step / (steps + 1))))
            g = np.concatenate([found[k].ravel() for k in names])
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            flat -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(flat.dtype)
        return loss

    def _parts(self) -> tuple[np.ndarray, np.ndarray, tuple[bool, bool], tuple[np.ndarray, np.ndarray]]:
        """What each class gives, and after the classes each place of the window, whose sums are used: its embedding h times `pair`, h, h times `pass_on`, and a one. The outputs with their bias. Whether the exponentials of weights and of outputs stay in range. `pair` and `pass_on`.

        A query times a key is h @ (q @ k.T) @ h.T, and what a value adds is h @ (v @ o): each product of two matrices is taken once.
        """
        p, d, real = self.p, WIDTH, self.p["out"].dtype
        pair, pass_on = p["q"] @ p["k"].T * real.type(d**-0.5), p["v"] @ p["o"]
        parts = np.zeros((CLASSES + WINDOW, 3 * d + 1), real)
        np.matmul(np.concatenate([p["embed"], p["place"]]), np.concatenate([pair, np.eye(d, dtype=real), pass_on], axis=1), out=parts[:, : 3 * d])
        parts[:CLASSES, 3 * d] = 1
        # The most that a weight or an output can be; below BOUND no exponential leaves the range of its type.
        size = np.sqrt(np.square(parts[:, : 2 * d]).reshape(-1, 2, d).sum(axis=2))
        size = float(np.prod(size[:CLASSES].max(axis=0) + size[CLASSES:].max(axis=0), dtype=np.float64))
        if size >= BOUND:  # a bound from the parts; their sums may be less
            table = self._table(parts)
            size = float(np.abs(table[:, :d] @ table[:, d : 2 * d].T).max())
        outs = np.concatenate([p["out"], p["bias"][None]])
        return parts, outs, (size < BOUND, float(np.abs(outs).sum(axis=0).max()) < BOUND), (pair, pass_on)

    @staticmethod
    def _table(parts: np.ndarray) -> np.ndarray:
        """Each class at each place of the window."""
        return (parts[:CLASSES, None] + parts[CLASSES:]).reshape(-1, parts.shape[1])

    def score(self, ids: np.ndarray, n: np.ndarray, rows: int = 256) -> np.ndarray:
        """Natural log-probability of each id; ids of texts end to end, each with its end, n (1 at least) of each text."""
        cls = self.classes[ids]
        begins = np.cumsum(n) - n
        before = np.append(np.int32(END_CLASS), cls)[:-1]  # the class before each id
        before[begins] = END_CLASS
        # A text's windows begin STRIDE apart. The first scores all its places, each later one its last STRIDE.
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start, left = begins[text] + k * STRIDE, np.minimum(n[text] - k * STRIDE, WINDOW)
        # Windows may run over the end of the last text.
        at, target = np.append(before, np.zeros(WINDOW, np.int32)).astype(np.int64) * WINDOW, np.append(cls, np.zeros(WINDOW, np.int32)).astype(np.int64)
        out, first, (parts, outs, self.mild, _) = self.share[ids].copy(), k == 0, self._parts()
        table = self._table(parts)
        for some, skip in ((first, 0), (~first, WINDOW - STRIDE)):
            begin, size = start[some], left[some]
            for a in range(0, len(begin), rows):
                self._score_windows(table, outs, out, at, target, begin[a : a + rows], size[a : a + rows], skip)
        return out

    def _score_windows(self, table: np.ndarray, outs: np.ndarray, out: np.ndarray, at: np.ndarray, target: np.ndarray, start: np.ndarray, left: np.ndarray, skip: int) -> None:
        """Adds the log-probability of the class at the places of the windows from `skip` on."""
        mild, d, steps = self.mild, WIDTH, np.arange(WINDOW)
        many, own = len(start), WINDOW - skip
        x = np.take(table, at[start[:, None] + steps] + steps, axis=0, out=self._held("f", many, WINDOW, table.shape[1]), mode="clip")
        weight = np.matmul(x[:, skip:, :d], x[:, :, d : 2 * d].transpose(0, 2, 1), out=self._held("a", many, own, WINDOW))
        if not mild[0]:
            weight -= np.where(self.before[skip:] > 0, weight, -np.inf).max(axis=2, keepdims=True)
            np.minimum(weight, 0, out=weight)  # later places, which the next line takes out
        np.exp(weight, out=weight)
        weight *= self.before[skip:]
        total = weight.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)
        mixed = np.matmul(weight, x[:, :, 2 * d : 3 * d], out=self._held("m", many, own, d)).reshape(-1, d)
        mixed *= (1 / total)[:, None]
        mixed += x[:, skip:, d : 2 * d].reshape(-1, d)
        _tanh(mixed)
        h = self._held("u", many * own, d + 1)  # with a one, which takes the bias
        h[:, :d], h[:, d] = mixed, 1
        z = np.matmul(h, outs, out=self._held("z", many * own, CLASSES))
        if not mild[1]:
            z -= z.max(axis=1, keepdims=True)
        here = start[:, None] + steps[skip:]
        picked = z.ravel()[np.arange(len(z)) * CLASSES + target[here].ravel()]
        value = (picked - np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))).reshape(here.shape)
        use = steps[skip:] < left[:, None]
        out[here[use]] += value[use]


def _tanh(x: np.ndarray) -> None:
    """In place; half the time of numpy's own, and as near to it as a number's last place at one."""
    x *= 2
    np.minimum(x, 2 * BOUND, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


def class_table(times: np.ndarray, contexts: np.ndarray, rounds: int = 12, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(class, log share in the class) of each id, from how often it is in the corpus and what stands around it.

    The last id is the end, a class of its own, as are the SINGLE most frequent
    others. The rest is grouped by the ids around them, by k-means in which an
    id weighs as often as it is seen; ids that are never seen spread over all
    groups, each with a tenth of an occurrence.
    """
    order, alone = np.argsort(-times[:-1], kind="stable"), SINGLE + 1
    classes = np.arange(len(times)) % (CLASSES - alone) + alone
    classes[order[:SINGLE]] = np.arange(1, alone)
    classes[-1] = END_CLASS
    rest = order[SINGLE:][times[order[SINGLE:]] > 0]
    if len(rest) > CLASSES:
        x, rng = contexts[rest], np.random.default_rng(seed)
        weight = times[rest].astype(np.float64)
        centre = x[rng.choice(len(rest), CLASSES - alone, replace=False, p=weight / weight.sum())]
        for _ in range(rounds):
            own = (x @ centre.T - 0.5 * (centre**2).sum(axis=1)).argmax(axis=1)
            by_class = np.argsort(own, kind="stable")
            first = np.searchsorted(own[by_class], np.arange(len(centre)))
            some = np.flatnonzero(np.diff(np.append(first, len(own))))
            weighed = weight[by_class, None].astype(np.float32)
            centre[some] = np.add.reduceat(x[by_class] * weighed, first[some], axis=0) / np.add.reduceat(weighed, first[some], axis=0)
        classes[rest] = own + alone
    mass = times + 0.1
    return classes, np.log(mass / np.bincount(classes, mass, CLASSES)[classes])


def _contexts(texts: DataFrame, times: np.ndarray, kind: str, look: int = 96) -> np.ndarray:
    """For each id the square roots of the shares of the `look` most frequent ids among all those before and after it.

    Tasks send their sums by blocks of NEAR ids, whose sums Spark's groups add up.
    """
    vocabulary, width = len(times), 2 * (look + 1)
    rank = np.full(vocabulary, look)
    rank[np.argsort(-times, kind="stable")[:look]] = np.arange(min(look, vocabulary))
    size = NEAR * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, one = np.zeros(-(-vocabulary // NEAR) * size, np.int32), np.int32(1)  # a one of another type is ten times slower
        for batch in batches:
            flat, edge = _laid(batch["ids"], kind)
            laid = np.append(vocabulary - 1, with_end(flat, np.diff(edge), vocabulary - 1)[0]).astype(np.int64)  # each text's end stands before the next
            a, b = laid[:-1], laid[1:]
            np.add.at(sums, b * width + rank[a], one)
            np.add.at(sums, a * width + look + 1 + rank[b], one)
        found = np.flatnonzero(sums)
        block, first = np.unique(found // size, return_index=True)
        edge = np.append(first, len(found))
        for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            own = found[x:y]
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[i : i + 1].astype(np.int32)), "at": [(own % size).astype("<u4").tobytes()], "n": [sums[own].astype("<i8").tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        sums = np.zeros(size, np.int64)
        for at, n in zip(table["at"], table["n"], strict=True):
            sums[np.frombuffer(at.as_buffer(), "<u4")] += np.frombuffer(n.as_buffer(), "<i8")
        found = np.flatnonzero(sums)
        return pa.table({"block": table["block"][:1], "at": [found.astype("<u4").tobytes()], "n": [sums[found].tobytes()]})

    out, schema = np.zeros(-(-vocabulary // NEAR) * size, np.float32), "block int, at binary, n binary"
    for row in texts.select("ids").mapInArrow(run, schema).groupBy("block").applyInArrow(added, schema).toArrow().to_pylist():  # a row for NEAR ids
        out[row["block"] * size + np.frombuffer(row["at"], "<u4").astype(np.int64)] = np.frombuffer(row["n"], "<i8")
    out = out[: vocabulary * width].reshape(vocabulary, 2, look + 1)
    out /= np.maximum(out.sum(axis=2, keepdims=True), 1)
    return np.sqrt(out, out=out).reshape(vocabulary, width)


def _matrix(ids: pa.Array) -> np.ndarray:
    return ids.flatten().to_numpy(zero_copy_only=False).reshape(-1, WINDOW + 1)


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary < 1 << 16 else "<u4"


def encoded_texts(texts: DataFrame, path: str, kind: str) -> DataFrame:
    """doc_id, text, ids (as bytes of little-endian numbers) for each text; a null one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, n in encoded(batch["text"], path, 1 << 20):
                flat, at = ids.astype(kind), np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(n)), batch["text"].slice(first, len(n)), held], ["doc_id", "text", "ids"])

    return texts.mapInArrow(run, "doc_id long, text string, ids binary")


def _laid(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows end to end, where each row's begin, one more than rows)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _windows(end: int, share: float, slots: int, most: int = 1 << 18):
    """Rows of slot, at (a hash), ids: the windows of the blocks that are taken.

    A window is the id before it and WINDOW ids. `end`, the size of the
    vocabulary, is the id of the end, which stands before a text too; places
    after a block's end are -1.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, kind = np.arange(WINDOW + 1), _kind(end)
        for batch in batches:
            own, (flat, edge) = batch["doc_id"].fill_null(-1).to_numpy().view(np.uint64), _laid(batch["ids"], kind)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(edge, edge[first] + most, side="right")) - 1)
                laid, at = with_end(flat[edge[first] : edge[last]], np.diff(edge[first : last + 1]), end)
                text = np.repeat(np.arange(last - first), np.diff(at))
                place = np.arange(len(laid)) - at[:-1][text]
                block = place // BLOCK
                ends = at[1:] - 1
                block[ends] = np.maximum(place[ends] - 1, 0) // BLOCK  # a text's end is in the block of its last id
                key = spans.mixed(own[first:last][text] + spans.mixed(block.astype(np.uint64) + np.uint64(SEED)))
                first = last
                taken = key <= limit
                if not taken.any():
                    continue
                text, block, key, laid = text[taken], block[taken], key[taken], laid[taken].astype(np.int64)
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (block[1:] != block[:-1])))
                heads, sizes = block[new] == 0, np.diff(np.append(new, len(laid)))
                # Each block's ids, after the mark of a text's beginning if it is the first.
                laid, froms, sizes = np.insert(laid, new[heads], end), new + np.cumsum(heads) - heads, sizes + heads
                many = np.maximum(0, -(-(sizes - 1) // WINDOW))
                of = np.repeat(np.arange(len(new)), many)
                k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                here = k[:, None] * WINDOW + steps
                rows = np.where(here < sizes[of, None], laid[np.minimum(froms[of, None] + here, len(laid) - 1)], -1).astype(np.int32)
                marks = spans.mixed(key[new][of] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (WINDOW + 1)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array((marks % np.uint64(slots)).astype(np.int32)), pa.array(marks.view(np.int64)), lists], ["slot", "at", "ids"])

    return run


def _dealt(texts: DataFrame, slots: int) -> DataFrame:
    """slot, at (a hash), doc_id, ids of all texts, each whole: only Spark's own functions, no list of windows is shuffled."""
    own = texts.select(F.xxhash64("doc_id", "ids", F.lit(SEED)).alias("at"), "doc_id", "ids")
    return own.select(F.pmod("at", F.lit(slots)).cast("int").alias("slot"), "at", "doc_id", "ids")


def _of_windows(table: pa.Table) -> np.ndarray:
    """A slot's windows, where its rows are windows, in an order of their own."""
    table = table.sort_by([("at", "ascending")])
    ids, at = _matrix(table["ids"].combine_chunks()), table["at"].to_numpy()
    return ids[np.lexsort((*ids.T[::-1], at))] if (at[1:] == at[:-1]).any() else ids


def _of_texts(end: int):
    """A slot's windows, where its rows are texts: all of them."""

    def run(table: pa.Table) -> np.ndarray:
        texts = table.sort_by([("at", "ascending")]).select(["doc_id", "ids"]).combine_chunks()  # texts of one hash are alike
        return np.concatenate([_matrix(b["ids"]) for b in _windows(end, 1.0, 1)(iter(texts.to_batches()))])

    return run


def _trained(model: Attention, dealt: DataFrame, slots: int, windows=_of_windows) -> Attention:
    """The model after ROUNDS rounds, each over its share of the rows, which have slot, at and what `windows` makes windows of."""
    spark, names = dealt.sparkSession, sorted(model.p)
    to_class = np.append(model.classes, -1).astype(np.int32)  # the last for places after a text
    for r in range(ROUNDS):
        p = model.p

        def run(table: pa.Table) -> pa.Table:
            rows = to_class[windows(table)]
            own = Attention(np.zeros(0), np.zeros(0))
            own.p = {k: v.copy() for k, v in p.items()}
            own.train(rows, r / ROUNDS, 1 / ROUNDS, SEED + r)
            flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float32)
            return pa.table({"slot": table["slot"][:1], "n": pa.array([len(rows)], pa.int64()), "p": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))})

        own = dealt.where(F.pmod(F.shiftrightunsigned("at", 40), F.lit(ROUNDS)) == r).repartition(max(1, min(slots, 4 * partitions(spark))), "slot")
        found = own.groupBy("slot").applyInArrow(run, "slot int, n long, p array<float>").select("n", F.posexplode("p").alias("at", "p"))
        whole = F.round(F.col("p").cast("double") * FIXED).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
        mean = found.groupBy("at").agg((F.sum(whole).cast("double") / F.sum("n") / FIXED).alias("p")).toArrow().sort_by("at")  # a row for each weight
        if not len(mean):
            continue
        flat = mean["p"].to_numpy().astype(np.float32)
        cut = np.cumsum([p[k].size for k in names])[:-1]
        model.p = {k: v.reshape(p[k].shape) for k, v in zip(names, np.split(flat, cut), strict=True)}
    return model


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = spans.LOWER[data]
    starts, ends, n = spans.words(data, at)
    return spans.hashes(data, starts, ends), n


def _counts(vocabulary: int):
    """kind 0: (hash of a word, times); kind 1: (id, times). Sums over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, docs, times, kind = [], 0, 0, np.zeros(vocabulary + 1, np.int64), _kind(vocabulary)

        def folded() -> pa.RecordBatch:
            keys, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            found.clear()
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return _rows(0, keys[first], np.add.reduceat(n, first))

        for batch in batches:
            times[:-1] += np.bincount(_laid(batch["ids"], kind)[0], minlength=vocabulary)
            for _, _, data, at in spans.chunks(batch["text"], 1 << 20):
                docs += len(at) - 1
                h, _ = _word_hashes(data, at)
                if len(h):
                    found.append(np.unique(h, return_counts=True))
                    held += len(found[-1][0])
                if held > 1_000_000:  # what one task holds is bounded; a word may then make several rows
                    yield folded()
                    held = 0
        if found:
            yield folded()
        if docs:
            times[-1] = docs
            yield _rows(0, np.array([END_KEY], np.uint64), np.array([docs]))
            there = np.flatnonzero(times)
            yield _rows(1, there.astype(np.uint64), times[there])

    return run


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def score_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    A null or empty text has one token, the end: its score is that of an end
    right at the beginning. Rows that repeat are each learned from and scored;
    null ids count as the empty id. Without training documents the base takes
    every token as new, and the model is as it begins. An empty table gives an
    empty one.

    Tasks get texts and ids in batches of PASSED bytes, so that what a worker and its JVM hold
    doesn't grow with the texts.
    """
    with arrow_batches(docs.sparkSession, PASSED):
        return _score_texts(docs, tokenizer)


def _score_texts(docs: DataFrame, tokenizer: str | None) -> DataFrame:
    path = tokenizer or default_path()
    vocabulary = len(Subwords.at(path).bytes_of)
    kind = _kind(vocabulary)
    texts = kept(encoded_texts(document_text(docs), path, kind), "encoded")
    train = texts.where(fold(5) != 1)

    # Rows go out before they are summed: a task has summed its own, so a second table of them would only take memory.
    counted = kept(train.select("text", "ids").mapInArrow(_counts(vocabulary), "kind int, key long, n long").repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    times = np.zeros(vocabulary + 1, np.int64)
    for batch in counted.where("kind = 1").select("key", "n").toArrow().to_batches():  # a row for each id
        times[batch["key"].to_numpy()] = batch["n"].to_numpy()
    slots = max(1, round(times.sum() / WINDOW / ROUNDS / SLOT))
    model = _trained(Attention(*class_table(times, _contexts(train, times, kind))), _dealt(train, slots), slots, _of_texts(vocabulary))

    words = counted.where("kind = 0")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, floor = totals.n, totals.n + 0.5 * (totals.v + 1)
    head = words.orderBy(F.desc("n"), "key").limit(HEAD).select("key", "n").toArrow().sort_by("key")  # HEAD rows
    order = np.argsort(head["key"].to_numpy().view(np.uint64))
    head_keys, head_n = head["key"].to_numpy().view(np.uint64)[order], head["n"].to_numpy()[order]
    head_log = np.log10((head_n + 0.5) / floor) if floor else np.zeros(0)
    new_log = float(np.log10(0.5 / floor)) if floor else 0.0
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            flat, edge = _laid(batch["ids"], kind)
            for first, last, data, at in spans.chunks(batch["text"], 1 << 20):
                texts = last - first
                h, n = _word_hashes(data, at)
                owner = np.repeat(np.arange(texts), n)
                order, where = np.argsort(h), np.empty(len(h), np.int64)  # sorted keys are found in half the time
                where[order] = np.minimum(np.searchsorted(head_keys, h[order]), max(len(head_keys) - 1, 0))
                hit = head_keys[where] == h if len(head_keys) else np.zeros(len(h), bool)
                base = np.bincount(owner[hit], head_log[where[hit]], texts)
                known = np.bincount(owner[hit], minlength=texts)
                tail, tail_owner = h[~hit], owner[~hit]
                cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(tail_owner, minlength=texts))]).astype(np.int32))

                per = np.diff(edge[first : last + 1])
                laid, _ = with_end(flat[edge[first] : edge[last]], per, vocabulary)
                score = np.bincount(np.repeat(np.arange(texts), per + 1), model.score(laid, per + 1), texts) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(texts)), batch["doc_id"].slice(first, texts), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(cut, pa.array(tail.view(np.int64)))],
                    ["rid", "doc_id", "n_tokens", "known", "base", "score", "tail"],
                )
                rid += texts

    rows = kept(texts.mapInArrow(run, "rid long, doc_id long, n_tokens long, known long, base double, score double, tail array<long>"), "scored")
    remove_kept(texts)
    tail = rows.select("rid", F.explode("tail").alias("key"))  # a row for each time a word stands there: few stand twice in a text
    rare = words.select("key", F.col("n").alias("c"))
    sums = tail.join(rare, "key", "left").groupBy("rid").agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(floor) or 1.0))).alias("tail_log"), F.count("c").alias("tail_known")
    )
    end = int(np.searchsorted(head_keys, np.uint64(END_KEY))) if len(head_keys) else 0
    end_known = bool(len(head_keys)) and head_keys[end] == np.uint64(END_KEY)
    end_base = float(head_log[end]) if end_known else new_log
    out = rows.drop("tail").join(sums, "rid", "left")
    return out.select(
        "doc_id",
        (fold(5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(end_known)).alias("n_known"),
        F.lit(int(total)).alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_log", F.lit(0.0)) + end_base).alias("base_score"),
        "score",
    )
