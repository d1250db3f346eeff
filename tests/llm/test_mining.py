"""Hard negatives, collocations and language ID against plain loops and on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import collocations as C
from tapewright.llm import hard_negatives as H
from tapewright.llm import language_id as L

VECTORS = "vec_id long, label int, embedding array<float>, row string, rank int, place string"


def vectors(seed, n, dims, scale=1.0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)) * scale
    points[n // 2 : n // 2 + n // 5] = points[0]  # a common vector
    return [(int(i), int(rng.integers(0, 4)), [float(np.float32(x)) for x in p], "x", 1, "y") for i, p in enumerate(points)]


def brute_negatives(rows, every, k=5, share=(80, 100)):
    found, kept = [], {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[(i, label, tuple(v))] = [math.floor(256 * x) for x in v]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, q in kept.items():
        if a[0] % every:
            continue
        scored = sorted((-inner(q, v), b[0], b[1]) for b, v in kept.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            inside = [(n, i) for n, i, label in scored if label != a[1] and share[0] * -s <= share[1] * -n <= share[1] * -s]
            found += [(a[0], p, rank, i, -s, -n) for rank, (n, i) in enumerate(inside[:k], 1)]
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("dims, scale, values", [(16, 1.0, 1 << 19), (5, 0.02, 200), (24, 3.0, 1000), (3, 1e6, 600)])
def test_hard_negatives_equal_loops(spark, monkeypatch, dims, scale, values):
    """Several blocks, ties, a common vector, and magnitudes whose products pass doubles' exact range."""
    monkeypatch.setattr(H, "VALUES", values)
    rows = vectors(dims, 220, dims, scale)
    assert got(H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0)) == brute_negatives(rows, 20)


def test_hard_negatives_awkward_rows(spark):
    rows = vectors(2, 60, 4)
    rows += [rows[0], rows[7], (20, 3, [1.0, 2.0, 0.5, 0.1], "x", 1, "y")]  # repeats; an id with two rows
    rows += [(100, None, [1.0] * 4, "", 0, ""), (120, 1, None, "", 0, ""), (140, 1, [1.0, None, 0.0, 0.0], "", 0, ""), (160, 1, [float("nan")] * 4, "", 0, ""), (180, 1, [float("inf")] * 4, "", 0, ""), (None, 1, [9.0] * 4, "", 0, ""), (200, 1, [0.5, 0.25], "", 0, ""), (220, 2, [], "", 0, "")]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(H.hard_negatives(df, F.col("vec_id") % 20 == 0)) == brute_negatives(rows, 20)
    assert got(H.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0)) == []
    assert got(H.hard_negatives(df.where("vec_id % 20 = 1"), F.col("vec_id") % 20 == 0)) == []


def test_bounds_take_rows_off(spark):
    """The scan leaves fewer rows than it begins with long before the last dimension."""
    rng = np.random.default_rng(1)
    block = H.Block(np.arange(4000), np.zeros(4000, int), np.floor(256 * rng.normal(size=(4000, 64)) / np.arange(1, 65)))
    left = []

    def narrow(least, most):
        stay = most >= np.partition(least, -5)[-5]
        left.append(int(stay.sum()))
        return stay

    block.scan(np.floor(256 / np.arange(1.0, 65)), np.arange(4000), narrow)
    assert left[2] < 1000 and left[-1] < 50


DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n string, rank string, word string"


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß'-") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    vocabulary += ["Of", "OF", "of", "Élan", "élan"]
    passage = "once upon a time there was a very long passage"
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";"]) for w in words)
        rows.append((i, text + (passage if i % 3 else ""), rng.choice(["en", "de", None, "und"]), "s", 1, "p", "q", "r", "w"))
    rows += [rows[0], rows[1], (n, None, "en", None, None, None, None, None, None), (n + 1, "", None, None, None, None, None, None, None), (None, ". ,\n", "fr", None, None, None, None, None, None), (n + 2, "of the " * 30_000, "en", None, None, None, None, None, None)]
    return rows


def brute_phrases(rows, least, longest, first):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = collections.defaultdict(list)
    around = collections.Counter()
    for (lang, p), a in f.items():
        if len(p) > 2 and a >= least:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[lang, p[i:j]] = max(around[lang, p[i:j]], a)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and around[lang, p] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, le, r, n[lang], -s) for lang, x in found.items() for rank, (s, a, p, le, r) in enumerate(sorted(x)[:first], 1))


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, longest, first", [(8, 5, 2000), (3, 3, 40), (1, 5, 2000)])
def test_collocations_equal_loops(spark, least, longest, first):
    rows = corpus(least, 60)
    want = brute_phrases(rows, least, longest, first)
    assert len(want) > 15 and phrases(C.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least, longest, first)) == want


def test_collocations_of_awkward_tables(spark):
    df = spark.createDataFrame(corpus(1, 3), DOCS)
    assert phrases(C.collocations(df.limit(0))) == []
    assert phrases(C.collocations(df.where("text is null or text = ''"))) == []


def test_trie_bursts_spills_and_counts(monkeypatch):
    monkeypatch.setattr(C, "BURST", 200)
    monkeypatch.setattr(C, "LIMIT", 3000)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)
    trie, runs, want = C.Trie(), [], collections.Counter()
    for _ in range(20):
        paths = ids[rng.zipf(1.3, size=(3000, 4)) % 40]
        want.update(map(tuple, paths.tolist()))
        runs += trie.add(paths)
    assert trie.root.children and len(runs) > 20
    runs += trie.rest()
    got_ = collections.Counter()
    for paths, counts in runs:
        rows = list(map(tuple, paths.tolist()))
        assert rows == sorted(rows) and len(set(rows)) == len(rows)
        got_.update(dict(zip(rows, counts.tolist(), strict=True)))
    assert got_ == want


def test_equal_hashes_are_told_apart():
    paths = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [3, 4]], np.uint64)
    _, found, counts = C._combined(np.zeros(5, np.uint64), paths, np.ones(5, np.int64))
    assert dict(zip(map(tuple, found.tolist()), counts.tolist(), strict=True)) == {(1, 2): 2, (3, 4): 3}


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    paths = rng.integers(-(1 << 62), 1 << 62, (500, 3))
    bits = C.bloom(spark.createDataFrame([tuple(map(int, p)) for p in paths], "lang_id long, w1 long, w2 long"), 2)
    assert C._inside(bits, paths.view(np.uint64)).all()
    assert C._inside(bits, rng.integers(-(1 << 62), 1 << 62, (500, 3)).view(np.uint64)).mean() < 0.02


def spoken(seed, n):
    rng = random.Random(seed)
    parts = {"xx": ["the", "and", "ing", "tion", "er"], "yy": ["der", "ung", "sch", "ü", "keit"], "zz": ["que", "eau", "é", "les", "ment"], None: ["the", "ung"]}
    return [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 80))), k, "src", 1, None, None, "a", "b") for i in range(n) for k in [rng.choice(list(parts))]]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 3 == 1


def test_language_id_on_held_out_rows(spark):
    rows = spoken(1, 600)
    out = {r.doc_id: r for r in L.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    right = [out[i].lang_pred == k for i, _, k, *_ in rows if held(i) and k]
    assert sum(right) / len(right) > 0.97 and len(out) == len(rows)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.lang_pred in ("xx", "yy", "zz") for i, r in out.items())
    # Languages of held-out rows and sources change nothing.
    other = [(i, t, "no" if held(i) else k, "z", *rest) for i, t, k, _, *rest in rows]
    assert {r.doc_id: r for r in L.language_id(spark.createDataFrame(other, DOCS)).collect()} == out


def test_presence_kernel_equals_loops():
    texts = ["The théme, 12", "", "a", "ab ab", "xyz" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for row, text in zip(L.presence(data, at), texts, strict=True):
        raw = bytes(L._LETTER[list(text.encode())].tolist())
        want = {((int.from_bytes(raw[i : i + k], "big") + (k << 24)) * 2654435761 % 2**32) >> 18 for k in (1, 2, 3) for i in range(len(raw) - k + 1)}
        assert set(np.flatnonzero(row).tolist()) == want


def test_language_id_awkward_rows(spark):
    rows = spoken(2, 60) + [(900, None, "xx", None, None, None, None, None, None), (901, "", "xx", None, None, None, None, None, None), (902, "12 - 34\n", "yy", None, None, None, None, None, None), (None, "the and", "xx", None, None, None, None, None, None), (903, "ж", None, None, None, None, None, None, None), (904, "the and " * 40_000, None, None, None, None, None, None, None)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, DOCS)
    out = L.language_id(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (900, 901, 902):
            assert r.lang_pred == "und" and r.score == 0.0
        else:
            assert r.lang_pred in ("xx", "yy", "zz")
    assert next(r for r in out if r.doc_id == 904).lang_pred == "xx"
    assert L.language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in L.language_id(df.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}


def test_every_language_is_learned(spark):
    """A language of a few texts among many of another still takes part in the fit."""
    rows = [(i, "der ung sch keit " * 3, "yy", None, None, None, None, None, None) for i in range(500)] + [(1000 + i, "que eau les ment " * 2, "zz", None, None, None, None, None, None) for i in range(9)]
    out = {r.doc_id: r.lang_pred for r in L.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[1000 + i] == "zz" for i in range(9)) and out[3] == "yy"
