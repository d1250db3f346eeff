"""Models and the pipeline against plain loops."""

import collections
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewright.llm import fingerprint, mixing, packing, quality_qda, quality_rules, spans, statistics, subwords, toxicity
from test_operators import WORD, brute_components, low, made, rows, shingles


def held(i, m=5):
    return zlib.crc32(str(i).encode()) % m == 0


def test_fingerprint_bins_and_densification():
    """Each bin's least hash, and each empty bin's donor, by loops."""
    texts = [r[1] for r in rows(8, 12)] + ["a few words only here", None, " "]
    got = fingerprint.fingerprints(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        found = [x for _, sets in spans.shingle_sets(pa.array([text]), fingerprint.WIDTH) for x in sets[0].tolist()]
        assert row[fingerprint.BINS] == bool(found)
        if not found:
            continue
        least = {}
        for h in found:
            b = h >> 56
            least[b] = min(h, least.get(b, h))
        for b in range(fingerprint.BINS):
            at = int(fingerprint._START[b]) % fingerprint.BINS
            while b not in least and at not in least:
                at = (at + int(fingerprint._STEP[b])) % fingerprint.BINS
            assert row[b] == (least[b] if b in least else least[at]) & 255


def test_likeness_takes_chance_off():
    rng = np.random.default_rng(1)
    a, b = (np.append(rng.integers(0, 256, 256), 1).astype(np.uint8)[None] for _ in range(2))
    same = (a[0, :256] == b[0, :256]).mean()
    assert fingerprint.likeness(a, b)[0] == pytest.approx(max(0.0, (same - 1 / 256) / (1 - 1 / 256))) and fingerprint.likeness(a, a)[0] == 1.0
    none = np.zeros((1, 257), np.uint8)
    assert fingerprint.likeness(none, none)[0] == 1.0 and fingerprint.likeness(a, none)[0] == 0.0


def test_near_next_of_many(spark):
    t = {r[0]: r[1] or "" for r in rows(9, 60)}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    ids = sorted(t)
    for r in fingerprint.fingerprint_edits(df, shards=3).collect():
        x, y = shingles(t[r.doc_id], 5), shingles(t[ids[(ids.index(r.doc_id) + 1) % len(ids)]], 5)
        want = len(x & y) / len(x | y) if x or y else 1.0
        assert abs(r.near_next - want) < 0.16


def test_path_lengths_and_limit(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(300, 4)), 1)
    forest = quality_rules.grow(points)
    got = quality_rules.oddness(points, forest)

    def c(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def walk(tree, node, point):
        k = forest[0][tree, node]
        if k < 0:
            return forest[2][tree, node]
        return walk(tree, 2 * node + 1 + int(point[k] >= forest[1][tree, node]), point)

    for i in range(0, 300, 37):
        mean = sum(walk(t, 0, points[i]) for t in range(quality_rules.TREES)) / quality_rules.TREES
        assert got[i] == pytest.approx(2 ** (-mean / c(quality_rules.LEAVES)))
    # A tree's leaves hold each of its points once, at the depth that the path says.
    small = quality_rules.grow(points[:50])
    for tree in range(3):
        leaf = collections.Counter()
        for p in points[:50]:
            node = level = 0
            while small[0][tree, node] >= 0:
                node, level = 2 * node + 1 + int(p[small[0][tree, node]] >= small[1][tree, node]), level + 1
            leaf[node, level] += 1
        assert all(small[2][tree, node] == pytest.approx(level + c(n)) for (node, level), n in leaf.items())
    # The limit: the best of all cuts, by loops.
    odd, bad = rng.uniform(0, 1, 400), rng.uniform(0, 1, 400) < 0.3
    odd[bad] = np.minimum(odd[bad] + 0.4, 0.999)
    step = np.floor(odd * quality_rules.STEPS)
    scored = spark.createDataFrame([(i, float(x)) for i, x in enumerate(odd)], "doc_id long, oddness double")
    labels = spark.createDataFrame([(i, int(not x)) for i, x in enumerate(bad)], "doc_id long, quality int")
    gain = {s: (step[bad] > s).mean() - quality_rules.GOOD * (step[~bad] > s).mean() for s in range(quality_rules.STEPS + 2)}
    best = max(s for s in gain if gain[s] >= max(gain.values()) - 1e-12)
    assert quality_rules.threshold(scored, labels) == pytest.approx((best + 1) / quality_rules.STEPS)


def test_discriminant_densities(spark):
    """Scores from log-densities with inverse and determinant of the shrunk covariance, sums by loops."""
    d, y = made(spark, 11)
    label = {r.doc_id: r.quality for r in y.collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    x = {}
    for i, t in text.items():
        for _, _, data, at in spans.chunks(pa.array([t])):
            x[i] = statistics.shares(statistics.counts(data, at))[0]
    train = [i for i in x if not held(i)]
    p, n = quality_qda.P, len(train)
    mean = [math.fsum(x[i][k] for i in train) / n for k in range(p)]
    scale = [math.sqrt(max(math.fsum((x[i][k] - mean[k]) ** 2 for i in train) / n, 1e-8)) for k in range(p)]
    z = {i: [(x[i][k] - mean[k]) / scale[k] for k in range(p)] for i in x}
    density = {}
    for c in (0, 1):
        own = [z[i] for i in train if label[i] == c]
        m = [math.fsum(v[k] for v in own) / len(own) for k in range(p)]
        cov = np.array([[math.fsum((v[a] - m[a]) * (v[b] - m[b]) for v in own) / len(own) for b in range(p)] for a in range(p)])
        cov = (1 - quality_qda.SHRINK) * cov + (quality_qda.SHRINK * max(np.trace(cov) / p, quality_qda.RIDGE) + quality_qda.RIDGE) * np.eye(p)
        inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        density[c] = {i: math.log(len(own) / n) - 0.5 * logdet - 0.5 * float((np.array(z[i]) - m) @ inverse @ (np.array(z[i]) - m)) for i in x}
    for r in quality_qda.quality_classifier(d, y).collect():
        gap = max(-quality_qda.FLAT, min(quality_qda.FLAT, density[1][r.doc_id] - density[0][r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-gap)), rel=1e-5, abs=1e-9) and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_noisy_or_and_its_gradient(spark):
    rng = np.random.default_rng(2)
    sentences, y = np.array([3, 1, 4, 2]), np.array([1, 0, 1, 0])
    hit_sentence, hit_doc = np.array([0, 0, 1, 2, 3, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 3])
    hit_word = np.array([0, 1, 2, 1, 2, 0, 1])
    w, b = rng.normal(size=3), -1.5

    def loss(w, b):
        out = 0.0
        for d in range(4):
            mine = sorted(set(hit_sentence[hit_doc == d].tolist()))
            scores = [1 / (1 + math.exp(-(b + sum(w[k] for k, s in zip(hit_word, hit_sentence, strict=True) if s == q)))) for q in mine]
            scores += [1 / (1 + math.exp(-b))] * int(sentences[d] - len(mine))
            clean = math.prod(1 - s for s in scores)
            out -= math.log(1 - clean) if y[d] else math.log(clean)
        return out / 4 + toxicity.DECAY / 2 * sum(v * v for v in w)

    got, grad = toxicity.loss_and_gradient(w, b, y, sentences, hit_doc, hit_sentence, hit_word)
    assert got == pytest.approx(loss(w, b))
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-5
        assert grad[k] == pytest.approx((loss(w + step[:3], b + step[3]) - loss(w - step[:3], b - step[3])) / 2e-5, rel=1e-4, abs=1e-7)
    # A document's score from its sentences, split by loops.
    d, y = made(spark, 7)
    model = toxicity.fit(d, y)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    text = {r.doc_id: r.text for r in d.collect()}
    for r in toxicity.toxicity(d, y).collect():
        clean, words = 1.0, []
        for part in re.split(r"(?<=[.!?])[ \n]|\n", text[r.doc_id]):
            words = {re.sub(r"^[^\w]+(?=.)|(?<=.)[^\w]+$", "", low(x)) for x in WORD.findall(part)}
            if words:
                flat = [x.encode() for x in words]
                at = np.cumsum([0, *map(len, flat)])
                h = spans.hashes(np.frombuffer(b"".join(flat), np.uint8), at[:-1], at[1:])
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight.get(int(x), 0.0) for x in h))))
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.held_out == held(r.doc_id)


def brute_lines(docs):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    first = collections.defaultdict(set)
    for r in docs:
        for line in (r["text"] or "").split("\n"):
            first[key(line)].add(r["doc_id"])
    gone = {k: min(v) for k, v in first.items() if len(k) >= 10 and len(v) >= 2}
    out = []
    for r in docs:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if gone.get(key(x), r["doc_id"]) == r["doc_id"])
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


@pytest.fixture(scope="module")
def corpus():
    """Documents of which some are bad, some near copies, with shared lines, a repeated row and a column that pipelines use inside."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(90):
        body = [word() for _ in range(rng.randint(60, 300))] if i % 3 or i < 3 else list(out[i - 3]["text"].split("\n")[0].split(" "))
        if i % 3 == 0 and i > 2:
            body[rng.randrange(len(body))] = "edited"
        if i % 11 == 5:
            body = [w.upper() + "###" for w in body]
        text = " ".join(body) + ("\nA line that is shared by some documents" if i % 4 == 0 else "") + "\n" + " ".join(word() for _ in range(6))
        out.append({"doc_id": 7 * i, "text": text, "lang": "en", "source": rng.choice(["a", "b", "c", None]), "n_chars": len(text), "a.b": f"x{i}"})
    out.append(dict(out[10]))
    out.append({"doc_id": 5000, "text": None, "lang": "en", "source": "a", "n_chars": None, "a.b": None})
    out.append({"doc_id": 5001, "text": "", "lang": "en", "source": "a", "n_chars": 0, "a.b": None})
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"


def folder_of(spark, docs):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([tuple(r.values()) for r in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r["doc_id"], int("###" not in (r["text"] or "")), 0) for r in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_against_loops(spark, corpus):
    """run() against loops over all five stages; the forest's verdicts and the hashed draws are taken as given."""
    path = folder_of(spark, corpus)
    frame = lambda docs: spark.createDataFrame([tuple(r.values()) for r in docs], SCHEMA)
    odd = {r.doc_id: r.kept or r.base_failed for r in quality_rules.quality_rules(frame(corpus), spark.read.parquet(f"{path}/labels.parquet")).collect()}

    def base_failed(text):
        w = WORD.findall(text or "")
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    docs = [r for r in corpus if not base_failed(r["text"]) and odd[r["doc_id"]]]
    assert 40 < len(docs) < len(corpus) - 5 and not any("###" in r["text"] for r in docs)
    lined = brute_lines(docs)
    assert any(a["text"] != b["text"] for a, b in zip(docs, lined, strict=True))
    least = brute_components({r["doc_id"]: r["text"] for r in lined}, 5)
    docs = [r for r in lined if least[r["doc_id"]][1] == r["doc_id"]]
    assert len(docs) < len(lined) - 5
    mixed = collections.Counter()
    for r in mixing.mix(frame(docs)).collect():
        mixed[r.doc_id, r.text] += r.copies
    tk = subwords.Subwords(subwords.default_path()).library
    want, tokens = collections.Counter(), 0
    for (i, text), k in mixed.items():
        ids = np.array([*tk.encode(text, add_special_tokens=False).ids, 0], "<u4")
        many = -(-len(ids) // 2048)
        edges = [0, *range(len(ids) - (many - 1) * 2048, len(ids) + 1, 2048)]
        tokens += k * len(ids)
        for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())] += k
    got = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    place = collections.defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for parts in place.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(place) <= -(-tokens // 2048) + 2


def test_stages_keep_columns_and_take_awkward_tables(spark, corpus):
    none = folder_of(spark, [])
    assert corpus_pipeline.run(spark, none).count() == 0
    odd = corpus[:20] + [dict(corpus[3]), corpus[5] | {"doc_id": corpus[3]["doc_id"]}, corpus[7] | {"doc_id": None}, corpus[9] | {"doc_id": None}]
    path = folder_of(spark, odd)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(c) for c in ("_gone", "_id", "_source", "_size", "_copies", "row", "of", "keys", "named", "id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, path)
        assert left.columns == docs.columns, name
        found = left.collect()
        assert all(r[c] == c for r in found for c in ("_gone", "_id", "_source", "_size", "_copies", "row", "of", "keys", "named", "id")), name
        assert {r["a.b"] for r in found} <= {r["a.b"] for r in odd}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= len(odd)


def test_groups_of_packing_meet_again(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "word " * rng.choice([20, 300, 700, 900, 1500])) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(packing, "GROUP", 12)
    got = packing.best_fit(df).collect()
    load, at = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.sequence_id] += r.length
        at[r.sequence_id].append((r.offset, r.length))
    assert len(got) >= 300 and max(load.values()) <= 2048
    for parts in at.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()
        assert [a for a, _ in sorted(parts)] == ends[:-1]
    assert sum(2 * v <= 2048 for v in load.values()) <= 1 + 300 // 12 // 12
