"""Every operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import common, fingerprint, line_dedup, lm_score, mixing, near_dup, packing, quality_qda, quality_rules, spans, statistics, subwords, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, key string, n string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß한") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 260))] for _ in range(30)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    for i in range(n):
        words = list(base[i % 30]) if i % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  ", ". "]) for w in words)
        out.append((3 * i, text + ("\n" + shared if i % 5 == 0 else ""), "en", rng.choice(["a", "b", None]), len(text), "x", "y", "z", "w"))
    out += [(1001, None, None, None, None, None, None, None, None), (1002, "", "en", "a", 0, "", "", "", ""), (1003, " \n\t ", "en", "b", 4, "", "", "", "")]
    out += [(1004, "The Word", "en", "b", 8, "", "", "", ""), (1005, "the word", "en", "a", 8, "", "", "", ""), (1006, "x" * 50_000, "en", "a", 1, "", "", "", ""), (1007, ("long text " * 9000) + "end", "en", "a", 1, "", "", "", "")]
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.createDataFrame([(r[0], i % 3 and 1, int("abc" in (r[1] or "")), "extra") for i, r in enumerate(data)], "doc_id long, quality int, toxic int, score string")


def texts(data):
    return {r[0]: r[1] or "" for r in data}


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_words_and_hashes(data):
    arr = pa.array([r[1] for r in data])
    got = []
    for _, _, d, at in spans.chunks(arr, 2000):
        starts, ends, n = spans.words(d, at)
        cut = np.concatenate([[0], np.cumsum(n)])
        got += [[bytes(d[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [WORD.findall(r[1] or "") for r in data]


def test_fingerprint(spark, docs, data, empty):
    t = texts(data)
    ids = sorted(t)
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs, shards=5).collect()}
    assert sorted(got) == ids
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(docs).collect()}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        q = len(t[a]) // 4
        edited = t[a][: len(t[a]) - q] + t[b][:q]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == len(t[a]) and got[a].fingerprint == plain[a]
        x, y = shingles(t[a], 5), shingles(edited, 5)
        if x and y:
            assert abs(got[a].near_edited - len(x & y) / len(x | y)) < 0.16
    assert got[1004].fingerprint == got[1005].fingerprint != "" and got[1001].fingerprint == ""
    assert fingerprint.fingerprint_edits(empty).count() == 0
    one = docs.where("doc_id = 1004")
    assert fingerprint.fingerprint_edits(one).first().near_next == 1.0
    twice = docs.unionByName(docs)
    assert fingerprint.fingerprint_edits(twice).count() == 2 * len(ids)


def brute_components(t, k):
    sets, parent = {i: shingles(x, k) for i, x in t.items()}, {i: i for i in t}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(t)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, data, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, width).collect()}
    assert got == brute_components(texts(data), width)


def test_near_duplicates_of_a_loose_family(spark):
    """Many edits of one text that isn't there: long lists, hubs and blocks must find the same components as brute force."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    t = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        t[i] = " ".join(words)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 2).collect()}
    assert got == brute_components(t, 2)


def test_near_duplicates_awkward(spark, empty):
    assert near_dup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]


def test_mixing(docs, data, empty):
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in data:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names, total = sorted(x for x in size if x is not None) + [None], sum(size.values())
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: share.get(s, 3 * size[s]) for s in names}
    taken = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(texts(data)[r.doc_id])) and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s in names:  # no choice of documents can do better than half of the longest
        longest = max(len(WORD.findall(r[1] or "")) for r in data if r[3] == s)
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], longest / 2) + 1
        rate = target[s] / size[s]
        assert {r.copies for r in got if r.source == s} <= {int(rate), int(rate) + 1}
    assert sorted(r.taken for r in got) == sorted(r.taken for r in mixing.mix(docs.repartition(7)).collect())
    again = collections.Counter(r.doc_id for r in mixing.repeated(docs).collect())
    assert again == collections.Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(empty).count() == 0 and mixing.repeated(docs).columns == docs.columns


def test_draws_are_bernoulli_and_of_each_document_alone(spark):
    """Under one seed the share taken once more is the fraction, and a new document changes no draw but by the fraction."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    one = {r.doc_id: r.copies for r in mixing.mix(df, seeds=1).collect()}
    for s, n in (("x", 2000), ("y", 4000)):
        target = 4000.0 if s == "x" else 8000.0  # of 12,000 words in all
        part = target / (2 * n) % 1
        assert abs(sum(one[i] - int(target / (2 * n)) for i in one if (i % 3 == 0) == (s == "x")) / n - part) < 4 * (part * (1 - part) / n) ** 0.5 + 1e-9
    weighed = {r.doc_id: r.copies for r in mixing.mix(df, weights=(3, 2), seeds=1).collect()}
    more = df.unionByName(spark.createDataFrame([(9000, "a b", "x")], df.schema))
    again = {r.doc_id: r.copies for r in mixing.mix(more, weights=(3, 2), seeds=1).collect()}
    assert sum(weighed[i] != again[i] for i in weighed) <= 12  # those whose draw lies between the two fractions


CLASH = ["_gone", "_at", "_lines", "_left", "_source", "_size", "_id", "_copies", "_rate", "_stratum", "_place", "_best", "a.b", "row", "own", "at", "line", "lines", "h", "g", "of", "times", "part", "seed", "keys", "component", "c`d"]


def clashing(docs):
    return docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASH])


def values_are_whole(found):
    got = found.collect()
    names = found.columns
    for r in got:
        for c in CLASH:
            if c in names:
                assert r[names.index(c)] == f"{c}:{r.doc_id if r.doc_id is not None else 'null'}"
    return got


def awkward(spark):
    """Null ids, repeated ids with equal and with other texts, ties, empty texts."""
    found = [(None, "one two three four five six\nshared line here", "a"), (None, None, None), (1, "one two three four five six\nshared line here", "a"), (1, "one two three four five six\nshared line here", "a")]
    found += [(1, "another text of its own with words\nshared line here", None), (2, "", "b"), (2, " \n\t", "b"), (3, "one two three four five six\nshared line here", "b"), (4, None, "a")]
    return spark.createDataFrame([(*r, 0) for r in found], "doc_id long, text string, source string, n_chars long")


def test_clashing_columns_and_awkward_rows(spark, docs, labels):
    wide = clashing(awkward(spark)).cache()
    n = wide.count()
    assert len(values_are_whole(mixing.mix(wide))) == n
    values_are_whole(mixing.repeated(wide))
    got = values_are_whole(line_dedup.line_dedup(wide))
    assert len(got) == n
    kept = sorted((str(r.doc_id), r.text) for r in got)
    whole = "one two three four five six\nshared line here"
    # A null id comes first; the rows of id 1 are one document, which is not the first.
    assert kept == sorted([("None", whole), ("None", ""), ("1", ""), ("1", ""), ("1", "another text of its own with words"), ("2", ""), ("2", " \n\t"), ("3", ""), ("4", "")])
    for f in (fingerprint.fingerprint_edits, near_dup.near_duplicates, token_files.token_files, packing.best_fit, lm_score.score_texts):
        assert f(wide).count() >= n, f
    for f in (quality_rules.quality_rules, quality_qda.quality_classifier, toxicity.toxicity):
        for y in (labels, labels.unionByName(labels), labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))):
            assert f(wide, y).count() == n, f


def encoded(data):
    tk = subwords.Subwords(subwords.default_path()).library
    t = texts(data)
    return {i: np.array([*tk.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in t.items()}


def test_subwords_equal_the_library():
    rng = random.Random(1)
    letters = [" ", "a", "B", "é", "\n", " ", " ", "1", "'s", ".", "日", "  ", "　", "\u0085", "\t", "😀", "'", "<|endoftext|>"]
    arr = pa.array(["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, ""])
    tk = subwords.Subwords(subwords.default_path()).library
    got = []
    for _, ids, n in subwords.encoded(arr, subwords.default_path(), 3000):
        cut = np.concatenate([[0], np.cumsum(n)])
        got += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [tk.encode(x or "", add_special_tokens=False).ids for x in arr.to_pylist()]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, data, empty, planes):
    want, start = encoded(data), 0
    got = {r.doc_id: r for r in token_files.token_files(docs, planes=planes).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(want[i].tobytes()))
        start += len(want[i])
    assert len(got) == len(want) and token_files.token_files(empty).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_plane_file_round_trip(planes):
    ids = np.random.default_rng(3).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    f = token_files.PlaneFile(token_files.to_file([7, None], np.array([400, 600]), ids, planes, block=128))
    assert (f.read(0, 1000) == ids).all() and (f.read(100, 300) == ids[100:300]).all() and f.doc_ids == [7, None] and f.counts.tolist() == [400, 600]


def test_statistics(data):
    got = np.concatenate([statistics.counts(d, at) for _, _, d, at in spans.chunks(pa.array([r[1] for r in data]), 3000)])
    for r, c in zip(data, got, strict=True):
        t = r[1] or ""
        w, seen = WORD.findall(t), collections.defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert c[:6].tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(t)]


def test_least_hashed(spark, empty):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    for bound in (1, 40, 4999, 5000, 9000):
        want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(bound).collect()]
        assert [r.doc_id for r in common.least_hashed(df, bound, 3).collect()] == want
    assert common.least_hashed(empty, 5, 3).count() == 0


def test_quality_rules(spark, docs, labels, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got[1001].base_failed and not got[1001].kept and got[1007].base_failed
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(90)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(word().upper() + "***" for _ in range(90)), 0) for i in range(12)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df, df.select("doc_id", "quality")).collect()}
    assert sum(kept[i] for i, _, _ in good) >= 145 and not any(kept[i] for i, _, _ in bad)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept").count() > 0


def test_lm_base_is_exact(docs, data, empty):
    t = texts(data)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in t}
    c = collections.Counter()
    for i, x in t.items():
        if not held[i]:
            c.update(WORD.findall(low(x)))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    for i, x in t.items():
        tokens = [*WORD.findall(low(x)), None]
        assert got[i].held_out == held[i] and got[i].n_tokens == len(tokens) and got[i].train_tokens == n
        assert got[i].n_known == sum(c[w] > 0 for w in tokens)
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert got[i].score <= 0
    assert lm_score.score_texts(empty).count() == 0


def test_lm_score_beats_the_shares_of_its_ids(spark, monkeypatch):
    """On held-out texts the model gives more than each id's share among the training ids does, ends included; counts joined or sent are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    encoder = subwords.Subwords.at(subwords.default_path())
    rows = docs.select("doc_id", "text").toPandas()
    times, held = np.full(len(encoder.bytes_of) + 1, 0.1), {}
    for _, ids, n in subwords.encoded(pa.array(rows.text), subwords.default_path()):
        cut = np.concatenate([[0], np.cumsum(n)])
        for i, a, b in zip(rows.doc_id, cut[:-1], cut[1:], strict=True):
            own = np.append(ids[a:b], len(times) - 1)
            if got[i].held_out:
                held[i] = own
            else:
                np.add.at(times, own, 1)
    share = np.log10(times / times.sum())
    plain, model, size = sum(share[x].sum() for x in held.values()), sum(got[i].score for i in held), sum(len((x or "").encode()) for i, x in zip(rows.doc_id, rows.text, strict=True) if i in held)
    assert model / size > plain / size + 0.1, (model / size, plain / size)
    print("log10 a byte on held-out texts:", round(model / size, 4), "ids alone:", round(plain / size, 4))
    monkeypatch.setattr(lm_score, "HEAD", 50)  # most words are joined, not sent
    few = docs.where("doc_id < 60")
    want = {r.doc_id: r for r in lm_score.score_texts(few).collect()}
    monkeypatch.setattr(lm_score, "HEAD", 131_072)
    for r in lm_score.score_texts(few.repartition(7)).collect():
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-5) and r.base_score == pytest.approx(want[r.doc_id].base_score) and r.n_known == want[r.doc_id].n_known


def test_lm_score_of_an_empty_text_is_that_of_an_end(docs):
    got = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    assert got[1001].score == got[1002].score < 0 and got[1003].score < 0


def test_lm_score_windows_hold_each_id_once(data):
    path, chosen = subwords.default_path(), [r for r in data if r[1]]
    end = len(subwords.Subwords.at(path).bytes_of)
    lists = [ids[a:b].tolist() for _, ids, n in subwords.encoded(pa.array([r[1] for r in chosen]), path) for cut in [np.concatenate([[0], np.cumsum(n)])] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    as_bytes = lambda rows: pa.array([np.array(x, "<u2").tobytes() for x in rows], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in chosen]), as_bytes(lists)], ["doc_id", "ids"])

    def windows(share, most=1 << 18):
        return [x for b in lm_score._windows(end, share, 8, most)(iter([batch.slice(0, 40), batch.slice(40)])) for x in lm_score._matrix(b["ids"])]

    rows = windows(1.0)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, windows(1.0, 2000)))
    want = collections.Counter()
    for ids in lists:
        blocks = [ids[k : k + lm_score.BLOCK] for k in range(0, len(ids), lm_score.BLOCK)]
        blocks[-1] = [*blocks[-1], end]
        for k, block in enumerate(blocks):
            block = block if k else [end, *block]  # the first id of a later block stands only before the others
            for a in range(0, len(block) - 1, lm_score.WINDOW):
                row = block[a : a + lm_score.WINDOW + 1]
                want[(*row, *[-1] * (lm_score.WINDOW + 1 - len(row)))] += 1
    assert collections.Counter(map(tuple, (r.tolist() for r in rows))) == want
    assert 0 < len(windows(0.25)) < len(rows) / 2
    nothing = pa.RecordBatch.from_arrays([pa.array([1, 2]), as_bytes([[], []])], ["doc_id", "ids"])
    found = [x for b in lm_score._windows(end, 1.0, 8)(iter([nothing])) for x in lm_score._matrix(b["ids"])]
    assert [x[:3].tolist() for x in found] == [[end, end, -1]] * 2


def test_lm_score_learns_from_each_text_and_id(spark):
    """A training text whose words change places, so that all counts stay, changes what other texts get; each id and the end are learned."""
    rng = np.random.default_rng(3)
    words = ["river", "stone", "light", "moves", "under", "green", "hills", "while", "seven", "birds"]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, len(words), 40))) for i in range(12)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    scores = lambda some: {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    before, turned = scores(rows), next(i for i, _ in rows if i not in held)
    turn = lambda x: " ".join([x.split()[0], *x.split()[:0:-1]])
    after = scores([(i, turn(x) if i == turned else x) for i, x in rows])
    assert held and all(before[i] != after[i] for i in held)
    end, ids = 50_000, np.arange(1000, dtype="<u2")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([ids.tobytes()], pa.binary())], ["doc_id", "ids"])
    found = np.concatenate([lm_score._matrix(b["ids"])[:, 1:].ravel() for b in lm_score._windows(end, 1.0, 1)(iter([batch]))])
    assert sorted(found[found >= 0].tolist()) == [*range(1000), end]


def test_lm_score_passes_small_batches(spark, docs, monkeypatch):
    """While it runs a batch has PASSED bytes or so; afterwards the session is as it was."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    whole, before = lm_score.kept, spark.conf.get(name, None)
    monkeypatch.setattr(lm_score, "kept", lambda *a: (seen.append(spark.conf.get(name)), whole(*a))[1])
    lm_score.score_texts(docs)
    assert set(seen) == {str(lm_score.PASSED)} and spark.conf.get(name, None) == before
    rows = spark.range(20_000, numPartitions=1).select(F.repeat(F.lit("x"), 100).alias("text"))
    run = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    with common.arrow_batches(spark, 1 << 16):
        assert max(r.n for r in rows.mapInArrow(run, "n long").collect()) < 1 << 18


def test_encoder_keeps_pieces_met_again(monkeypatch):
    """A full memory loses the pieces met once, not those met again; a mark after letters makes no piece of its own; ids stay the library's."""
    path = subwords.default_path()
    own, learned = subwords.Subwords(path), []
    monkeypatch.setattr(subwords, "REMEMBER", 60)
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda keys, *a: (learned.extend(keys.tolist()), learn(keys, *a)))
    common = "the river runs under seven hills, and the light moves. Then it stops;\nthe river! runs: on? don't e.g. \u00e9t\u00e9, 1.5"
    for i in range(12):
        text = common + "".join(f" once{i}x{k}" for k in range(20))
        data = text.encode()
        ids, n = own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert len(own.known) <= 60 and max(collections.Counter(learned).values()) == 1
    data = np.frombuffer(b" hills, hills. hills", np.uint8)
    starts, ends, _ = subwords.pieces(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b" hills", b",", b" hills", b".", b" hills"]


def test_attention_gradients_and_windows():
    model = lm_score.Attention(np.arange(50) % lm_score.CLASSES, np.zeros(50))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, lm_score.CLASSES, (3, 7)), rng.integers(0, lm_score.CLASSES, (3, 7))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(x, y)
    for name in model.p:
        at = tuple(0 for _ in model.p[name].shape) if name != "embed" else (int(x[0, 0]), 0)
        old, eps = model.p[name][at], 1e-5
        model.p[name][at] = old + eps
        up = model.gradients(x, y)[0]
        model.p[name][at] = old - eps
        down = model.gradients(x, y)[0]
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-6)
    model = lm_score.Attention(np.arange(50) % lm_score.CLASSES, np.zeros(50))
    ids, n = rng.integers(0, 50, 131), np.array([1, 1, 20, 21, 88])
    got, begin = model.score(ids, n), 0
    for m in n:
        c = model.classes[ids[begin : begin + m]]
        for i in range(m):
            w = 0 if i < lm_score.WINDOW else -(-(i - lm_score.WINDOW + 1) // lm_score.STRIDE)
            before = [lm_score.END_CLASS if j == 0 else c[j - 1] for j in range(w * lm_score.STRIDE, i + 1)]
            assert got[begin + i] == pytest.approx(model.forward(np.array([before]))["z"][0, -1, c[i]], abs=1e-4)
        begin += m


def test_attention_scores_with_large_weights():
    """Where exponentials could leave the range of their type, the maximum is taken off; scores are finite and those of the plain pass."""
    rng = np.random.default_rng(1)
    for scale in ("q", "out"):
        model = lm_score.Attention(np.arange(50) % lm_score.CLASSES, np.zeros(50))
        model.p[scale] *= 1000
        ids, n = rng.integers(0, 50, 61), np.array([1, 40, 20])
        got, begin = model.score(ids, n), 0
        assert not all(model.mild) and np.isfinite(got).all()
        for m in n:
            c = model.classes[ids[begin : begin + m]]
            for i in range(m):
                w = 0 if i < lm_score.WINDOW else -(-(i - lm_score.WINDOW + 1) // lm_score.STRIDE)
                before = [lm_score.END_CLASS if j == 0 else c[j - 1] for j in range(w * lm_score.STRIDE, i + 1)]
                assert got[begin + i] == pytest.approx(model.forward(np.array([before]))["z"][0, -1, c[i]], rel=1e-2, abs=0.05)
            begin += m


def test_lm_training_means_are_weighted_and_free_of_order(spark):
    """One round over three slots gives the mean of what each slot finds alone, weighted by its windows."""
    rng = np.random.default_rng(2)
    rows = [(s, int(at), [int(x) for x in rng.integers(0, 60, lm_score.WINDOW + 1)]) for s, many in ((0, 5), (1, 9), (2, 2)) for at in rng.integers(0, 1 << 40, many)]
    fresh = lambda: lm_score.Attention(np.arange(60) % lm_score.CLASSES, np.zeros(60))
    windows = lambda some: spark.createDataFrame(some, "slot int, at long, ids array<int>")
    whole = lm_score._trained(fresh(), windows(rows).repartition(3), 3).p
    again = lm_score._trained(fresh(), windows(rows[::-1]).repartition(2), 3).p
    assert all((whole[k] == again[k]).all() for k in whole)
    alone = [(lm_score._trained(fresh(), windows([r for r in rows if r[0] == s]), 1).p, sum(r[0] == s for r in rows)) for s in range(3)]
    for k in whole:  # all marks are below 2^40: every window is of round 0, and the others are left out
        assert np.allclose(whole[k], sum(p[k] * n for p, n in alone) / len(rows), atol=1e-5)


def test_line_dedup(docs, data, empty):
    t = texts(data)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i in sorted(t):
        for k in {key(x) for x in t[i].split("\n")}:
            first.setdefault(k, []).append(i)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, x in t.items():
        left = [y for y in x.split("\n") if not (len(key(y)) >= 10 and len(first[key(y)]) >= 2 and first[key(y)][0] != i)]
        assert got[i].text == "\n".join(left) and got[i].n_lines == x.count("\n") + 1 and got[i].n_dropped == x.count("\n") + 1 - len(left)
    assert any(r.n_dropped for r in got.values()) and line_dedup.line_dedup(empty).count() == 0
    some = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, most=2).collect()}
    for i, x in t.items():
        assert some[i] == "\n".join(y for y in x.split("\n") if not (len(key(y)) >= 10 and len(first[key(y)]) > 2 and first[key(y)][0] != i))


def held_out_accuracy(found, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    hit = [int(r.predicted == y[r.doc_id]) for r in found if r.held_out]
    return sum(hit) / len(hit)


def made(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(500):
        words = [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(5, 120))]
        quality, toxic = int(i % 4 != 0), int(i % 5 == 0)
        if not quality:
            words = [w + "###" for w in words]
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["zounds", "gadzooks", "fie"])
        out.append((i, " ".join(words), quality, toxic))
    df = spark.createDataFrame(out, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_quality_classifier(spark, docs, labels, empty):
    d, y = made(spark, 4)
    found = quality_qda.quality_classifier(d, y).collect()
    assert held_out_accuracy(found, y, "quality") > 0.95
    got = quality_qda.quality_classifier(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_qda.quality_classifier(empty, labels).count() == 0
    assert {r.score for r in quality_qda.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    swapped = y.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_qda.quality_classifier(d, swapped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in found)


def test_toxicity(spark, docs, labels, empty):
    d, y = made(spark, 6)
    found = toxicity.toxicity(d, y).collect()
    assert held_out_accuracy(found, y, "toxic") > 0.95
    text = {r.doc_id: r.text for r in d.collect()}
    for r in found:
        for s in r.offending:
            assert any(w in text[r.doc_id].encode()[s.first : s.last].decode() for w in ("zounds", "gadzooks", "fie"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_packing(docs, data, empty):
    want = encoded(data)
    got = packing.best_fit(docs).collect()
    place, whole = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length <= 2048
        place[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, r.start, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, parts in whole.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and (length == 2048 or k == 0)
            at += length
        assert at == len(want[i])
    assert len(place) <= -(-sum(map(len, want.values())) // 2048) + 2
    assert packing.best_fit(empty).count() == 0


def test_pack_pairs_large_pieces():
    lengths = np.array([1500, 1400, 700, 690, 640, 500, 20])
    sequence, offset = packing.pack(lengths)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 2048 and (own > 2048 / 3).sum() <= 2


def test_packing_deals_repeated_rows_over_groups(spark, monkeypatch):
    """A third of all rows alike, without id and text: no group takes them all."""
    monkeypatch.setattr(packing, "GROUP", 200)
    df = spark.range(0, 1800, 1, 6).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a word "), F.col("id").cast("string"))).alias("text"))
    items = packing.pieces(df, None, packing.CAPACITY)
    sizes = [r["count"] for r in packing._dealt(items, ["doc_id", "piece", "ids_crc32"]).groupBy("g").count().collect()]
    assert len(sizes) == 9 and sum(sizes) == 1800 and max(sizes) < 300
    out = packing.best_fit(df).collect()
    assert len(out) == 1800
    ends = sorted((r.sequence_id, r.offset, r.length) for r in out)
    for (a, at, n), (b, then, _) in zip(ends, ends[1:], strict=False):
        assert then == (at + n if a == b else 0)
