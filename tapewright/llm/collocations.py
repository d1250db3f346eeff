"""Operator 12, phrase collocations: counts in a burst trie of hash containers.

Phrases are counted by length, one pass over the texts for each. A task keeps
counts in a shallow trie of word ids; its leaves are hash containers, of which
one that grows too large bursts into a node with a container for each next
word's range. Over its limit a task spills its largest subtrees as sorted runs:
blocks of phrases by range of prefixes, ids and counts as lists. Spark deals
blocks to partitions in order, where runs are merged as they come. A phrase
occurs no more often than its parts, so a pass takes only phrases whose first
and last words, but for one, were frequent enough; which these are is told by a
Bloom filter of a fixed size, whose errors cost time and no correctness.

A word's id is a 64-bit hash: two of D distinct words share one with a chance
of D * D / 2**65 (one in a million for six million words). The run stops if two
that were counted do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import kept, partitions

U64 = np.uint64
#: Distinct phrases: in a container before it bursts, in a task's trie before it spills.
BURST, LIMIT = 20_000, 600_000
#: Bits of a filter, and bits that one phrase sets.
BITS, PROBES = 1 << 25, 3
RUN_ROWS = 50_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, piece, text) of all words; pieces of different texts differ."""
    inside, edge = _WORD[data], at[1:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = edge[edge < len(data)], edge[edge > 0] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    text = np.searchsorted(at, starts, side="right") - 1
    return starts, np.flatnonzero(last) + 1, np.cumsum(_BREAK[data])[starts] + text, text


def phrase_hash(paths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ids: the language, then words."""
    out = np.full(len(paths), U64(paths.shape[1]))
    for column in paths.T:
        out = spans.mixed((out ^ column) * spans._PLACES[1] + spans._PLACES[2])
    return out


def _combined(hashes: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows once, with the sums of their counts."""
    order = np.argsort(hashes, kind="stable")
    hashes, paths, counts = hashes[order], paths[order], counts[order]
    new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    if not (paths == paths[begins[np.cumsum(new) - 1]]).all():  # two phrases of one hash: by ids instead
        paths, back = np.unique(paths, axis=0, return_inverse=True)
        return phrase_hash(paths), paths, np.bincount(back.ravel(), counts).astype(np.int64)
    return hashes[begins], paths[begins], np.add.reduceat(counts, begins) if len(begins) else counts


class Node:
    """A node of the trie: a hash container, or, once that burst, a node for each range of the next id."""

    def __init__(self, depth: int = 0) -> None:
        self.depth, self.parts, self.size, self.done, self.children = depth, [], 0, 0, None

    def add(self, hashes: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> int:
        """Takes distinct phrases; returns by how many rows the subtree grew."""
        if self.children is not None:
            return self._deal(hashes, paths, counts)
        before = self.size
        self.parts.append((hashes, paths, counts))
        self.size += len(hashes)
        if self.size > 2 * self.done + 4096:
            self._combine()
            if self.size > BURST and self.depth < paths.shape[1]:
                entries, self.parts, self.children = self.parts[0], [], {}
                self.size = 0
                return self._deal(*entries) - before
        return self.size - before

    def _combine(self) -> None:
        self.parts = [_combined(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = self.done = len(self.parts[0][0])

    def _deal(self, hashes: np.ndarray, paths: np.ndarray, counts: np.ndarray) -> int:
        slot = (paths[:, self.depth] >> U64(60)).astype(np.int8)
        grew = 0
        for s in np.unique(slot).tolist():
            at = slot == s
            grew += self.children.setdefault(s, Node(self.depth + 1)).add(hashes[at], paths[at], counts[at])
        self.size += grew
        return grew

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(paths, counts) of the whole subtree in the order of the ids."""
        parts = [c.run() for _, c in sorted(self.children.items())] if self.children is not None else []
        if self.children is None:
            self._combine()
            _, paths, counts = self.parts[0]
            order = np.lexsort(paths.T[::-1])
            return paths[order], counts[order]
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def leaves(self) -> list[tuple[Node, int]]:
        """(parent, slot) of each subtree that can be spilled alone."""
        if self.children is None:
            return []
        return [x for s, c in self.children.items() for x in (c.leaves() or [(self, s)])]


class Trie:
    def __init__(self) -> None:
        self.root = Node()

    def add(self, paths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts one occurrence of each row; yields runs that had to be spilled."""
        if len(paths):
            self.root.add(*_combined(phrase_hash(paths), paths, np.ones(len(paths), np.int64)))
        if self.root.size > LIMIT:
            largest = sorted(self.root.leaves(), key=lambda x: -x[0].children[x[1]].size)
            for parent, slot in largest:
                yield parent.children.pop(slot).run()
                self._resize(self.root)
                if self.root.size <= LIMIT // 2:
                    break

    def _resize(self, node: Node) -> int:
        if node.children is not None:
            node.children = {s: c for s, c in node.children.items() if c.children != {}}
            node.size = sum(self._resize(c) for c in node.children.values())
        return node.size

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.root.size:
            yield self.root.run()


def _probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield spans.mixed(hashes + spans._PLACES[3 + i]) & U64(BITS - 1)


def bloom(frequent: DataFrame, width: int) -> np.ndarray:
    """Bits of the phrases in lang_id, w1 .. w(width). At most BITS / 64 rows come to the driver, whatever the phrases."""
    names = ["lang_id", *(f"w{i + 1}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hash(np.stack([batch[c].to_numpy(zero_copy_only=False).view(U64) for c in names], axis=1))
            for bit in _probes(hashes):
                yield pa.RecordBatch.from_arrays([pa.array((bit >> U64(6)).astype(np.int64)), pa.array((U64(1) << (bit & U64(63))).view(np.int64))], ["slot", "bits"])

    out = np.zeros(BITS // 64, U64)
    found = frequent.select(*names).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[found.slot.to_numpy(np.int64)] = found.bits.to_numpy(np.int64).view(U64)
    return out


def _inside(bits: np.ndarray, paths: np.ndarray) -> np.ndarray:
    found = np.ones(len(paths), bool)
    for bit in _probes(phrase_hash(paths)):
        found &= (bits[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)
    return found


def _codes(values: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct languages, their ids, the place of each row's)."""
    coded = values.cast(pa.string()).fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    lengths = [len(x.encode()) for x in names]
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    data = np.frombuffer("".join(names).encode(), np.uint8)
    return names, spans.hashes(data, at[:-1], at[1:]), coded.indices.to_numpy(zero_copy_only=False)


def _block(paths: np.ndarray, bits: int) -> np.ndarray:
    """The block of each phrase: its range of first words, and a quarter of the second ones, since a first word may be common."""
    block = (paths[:, 1] >> U64(64 - bits)).astype(np.int64) * 4
    return block + (paths[:, 2] >> U64(62)).astype(np.int64) if paths.shape[1] > 2 else block


def _names(width: int) -> list[str]:
    return [f"w{i + 1}" for i in range(width)]


def phrase_runs(texts: DataFrame, width: int, filters: list, bits: int) -> DataFrame:
    """lang, lang_id, block, w1 .. w(width), n, word: runs of the tasks; a row is a block of one language in order, ids and counts as lists.

    filters: broadcast bits of the frequent phrases of one word less, or none
    for single words. Single words come with rows of all words (block -1, n
    alone), pairs with the letters of each frequent word (word, its id as w1).
    """
    ids = _names(width)
    names = ["lang", "lang_id", "block", *ids, "n", "word"]
    longs, texts_ = pa.list_(pa.int64()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, langs, letters, total = Trie(), {}, {}, {}
        known = filters[0].value if filters else None

        def batch_of(lang: np.ndarray, block: np.ndarray, columns: list[pa.Array | None], n: pa.Array | None, word: pa.Array | None) -> pa.RecordBatch:
            of, rows = pa.array([langs[x] for x in lang.tolist()], pa.string()), len(lang)
            columns = [pa.nulls(rows, longs) if c is None else c for c in [*columns, n]]
            return pa.RecordBatch.from_arrays([of, pa.array(lang.view(np.int64)), pa.array(block.astype(np.int32)), *columns, pa.nulls(rows, texts_) if word is None else word], names)

        def blocks(paths: np.ndarray, values: list[np.ndarray | None], spelt: list[str] | None = None) -> Iterator[pa.RecordBatch]:
            block = _block(paths, bits)
            order = np.lexsort((block, paths[:, 0]))
            for k in range(0, len(order), RUN_ROWS):
                at = order[k : k + RUN_ROWS]
                begins = np.flatnonzero(np.append(True, (block[at][1:] != block[at][:-1]) | (paths[at, 0][1:] != paths[at, 0][:-1])))
                edges = pa.array(np.append(begins, len(at)).astype(np.int32))
                lists = [None if v is None else pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(v[at]).view(np.int64))) for v in values]
                word = None if spelt is None else pa.ListArray.from_arrays(edges, pa.array([spelt[i] for i in at.tolist()], pa.string()))
                yield batch_of(paths[at, 0][begins], block[at][begins], lists[:-1], lists[-1], word)

        def out(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for paths, counts in runs:
                yield from blocks(paths, [*paths.T[1:], counts])

        for batch in batches:
            of, lang_ids, lang_at = _codes(batch["lang"])
            langs.update(zip(lang_ids.tolist(), of, strict=True))
            for first, last, data, at in spans.chunks(batch["text"]):
                data = spans.LOWER[data]
                starts, ends, piece, text = words_of(data, at)
                w = spans.hashes(data, starts, ends)
                lang = lang_ids[lang_at[first:last]][text]
                begins = np.arange(max(len(w) - width + 1, 0))
                if width == 1:
                    for x, n in enumerate(np.bincount(lang_at[first:last][text], minlength=len(of)).tolist()):
                        total[int(lang_ids[x])] = total.get(int(lang_ids[x]), 0) + n
                elif width == 2:
                    fine = _inside(known, np.stack([lang, w], axis=1))
                    at_word = np.flatnonzero(fine)
                    at_word = at_word[np.unique(w[at_word] ^ lang[at_word], return_index=True)[1]]
                    for x, y, i, j in zip(lang[at_word].tolist(), w[at_word].tolist(), starts[at_word].tolist(), ends[at_word].tolist(), strict=True):
                        if (x, y) not in letters:
                            letters[x, y] = data[i:j].tobytes()
                    begins = np.flatnonzero(fine[1:] & fine[:-1] & (piece[1:] == piece[:-1]))
                else:
                    begins = begins[piece[width - 1 :] == piece[: len(begins)]]
                    for part in range(2):  # both parts of one word less
                        sub = np.stack([lang[begins], *(w[begins + part + i] for i in range(width - 1))], axis=1)
                        begins = begins[_inside(known, sub)]
                yield from out(trie.add(np.stack([lang[begins], *(w[begins + i] for i in range(width))], axis=1)))
        yield from out(trie.rest())
        if total:
            yield batch_of(np.array(list(total), U64), np.full(len(total), -1), [None] * width, pa.array([[n] for n in total.values()], longs), None)
        if letters:
            yield from blocks(np.array(list(letters), U64), [np.array([w for _, w in letters], U64), *[None] * width], [x.decode() for x in letters.values()])

    return texts.mapInArrow(run, ", ".join(["lang string, lang_id long, block int", *(f"{c} array<long>" for c in ids), "n array<long>, word array<string>"]))


def merged(runs: DataFrame, width: int, bits: int, least: int) -> DataFrame:
    """lang, lang_id, w1 .. w(width), n, word: the phrases that all runs together hold at least `least` times, and the other rows, one for each value.

    A partition holds whole blocks in order; of a block that goes on in the
    next batch, what is known so far is kept, summed.
    """
    ids = _names(width)
    schema = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in ["lang_id", *ids, "n"]), ("word", pa.string())])

    def rows(lang: list[str], columns: dict[str, np.ndarray], word: pa.Array | None = None) -> pa.RecordBatch:
        n = len(lang)
        values = {"lang": pa.array(lang, pa.string()), "word": pa.nulls(n, pa.string()) if word is None else word}
        values |= {c: pa.array(np.ascontiguousarray(v).view(np.int64)) for c, v in columns.items()}
        return pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, langs, seen = (np.zeros((0, width + 1), U64), np.zeros(0, np.int64)), {}, (None, set())

        def often(paths: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            at = counts >= least
            return rows([langs[x] for x in paths[at, 0].tolist()], {**dict(zip(["lang_id", *ids], paths[at].T, strict=True)), "n": counts[at]})

        for batch in batches:
            names, lang_id = np.array(batch["lang"].to_pylist(), object), batch["lang_id"].to_numpy(zero_copy_only=False)
            langs.update(zip(lang_id.view(U64).tolist(), names.tolist(), strict=True))
            single = batch["w1"].is_valid().to_numpy(zero_copy_only=False)
            counted = batch["n"].is_valid().to_numpy(zero_copy_only=False)
            flat = lambda c, at: pc.list_flatten(batch[c].filter(pa.array(at)))  # noqa: E731, B023
            sums, spelt, phrases = ~single & counted, single & ~counted, single & counted
            if sums.any():
                yield rows(names[sums].tolist(), {"lang_id": lang_id[sums], "n": flat("n", sums).to_numpy(zero_copy_only=False)})
            for i in np.flatnonzero(spelt).tolist():  # letters come from many tasks
                key = lang_id[i], batch["block"][i].as_py()
                seen = seen if seen[0] == key else (key, set())
                new = [x for x in zip(batch["w1"][i].as_py(), batch["word"][i].as_py(), strict=True) if x not in seen[1]]
                seen[1].update(new)
                if new:
                    yield rows([names[i]] * len(new), {"lang_id": np.full(len(new), lang_id[i]), "w1": np.array([x for x, _ in new], np.int64)}, pa.array([w for _, w in new], pa.string()))
            if phrases.any():
                sizes = pc.list_value_length(batch["n"].filter(pa.array(phrases))).to_numpy(zero_copy_only=False)
                columns = [np.repeat(lang_id[phrases], sizes), *(flat(c, phrases).to_numpy(zero_copy_only=False) for c in ids)]
                paths = np.concatenate([held[0], np.stack(columns, axis=1).view(U64)])
                counts = np.concatenate([held[1], flat("n", phrases).to_numpy(zero_copy_only=False)])
                end = paths[-1:]
                _, paths, counts = _combined(phrase_hash(paths), paths, counts)
                going_on = (paths[:, 0] == end[0, 0]) & (_block(paths, bits) == _block(end, bits)[0])
                held = paths[going_on], counts[going_on]
                yield often(paths[~going_on], counts[~going_on])
        yield often(*held)

    laid = runs.repartition(partitions(runs.sparkSession), "lang_id", "block").sortWithinPartitions("lang_id", "block")
    return laid.mapInArrow(run, ", ".join(["lang string", *(f"{c} long" for c in ["lang_id", *ids, "n"]), "word string"]))


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Phrases found at least `least` times (lang, phrase: ids of its words, n), their words (lang, id, word) if there are pairs, and all words of each language (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = min(partitions(spark).bit_length() + 1, 24)  # two to four ranges of first words for each partition
    levels, words, totals, filters = [], None, None, []
    for width in range(1, longest + 1):
        found = kept(merged(phrase_runs(texts, width, filters, bits), width, bits, least), f"phrases-{width}")
        if width == 1:
            totals = found.where("w1 is null").groupBy("lang").agg(F.sum("n").alias("n"))
        elif width == 2:
            words = found.where("word is not null").groupBy("lang", F.col("w1").alias("id")).agg(F.min("word").alias("word"), F.max("word").alias("last_word"))
            two = words.where("word <> last_word").first()
            if two is not None:
                raise RuntimeError(f"two words share an id: {two.word!r}, {two.last_word!r}")
        found = found.where(f"w{width} is not null")
        levels.append(found.select("lang", F.array(*(f"w{i + 1}" for i in range(width))).alias("phrase"), "n"))
        if width < longest:
            known = bloom(found, width)
            for old in filters:
                old.unpersist()
            if not known.any():
                break
            filters = [spark.sparkContext.broadcast(known)]
    return reduce(DataFrame.unionByName, levels), words, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to `longest` words.

    docs: text, lang; other columns are not looked at. A null text is empty, a
    null language `und`. Rows that repeat count each. A language without a
    phrase found `least` times gives no row, and neither does an empty table.
    Counts are exact over whole texts; the score is floor(1000 a n / (l r)) in
    decimals of 38 digits, which hold counts up to 10**16.
    """
    counts, words, totals = frequent_phrases(docs, least, longest)
    if words is None:
        return counts.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("n_part"))
    longer = counts.where(F.size("phrase") > 1).withColumnRenamed("n", "a")

    inner = longer.where(F.size("phrase") > 2).select("lang", "a", "phrase", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)).alias("size"))
    inner = inner.select("lang", "a", "phrase", "size", F.explode(F.sequence(F.lit(1), F.size("phrase") - F.col("size") + 1)).alias("at"))
    held = inner.groupBy("lang", F.slice("phrase", F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    own = kept(longer.join(held, ["lang", "phrase"], "left").where("around is null or around < a").drop("around"), "candidates")

    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("n_part").alias(name)), ["lang", side])
    wide = lambda c: f"cast({c} as decimal(17,0))"
    cuts = cuts.join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spelt = scored.select("lang", "phrase", F.posexplode("phrase").alias("at", "id")).join(words.drop("last_word"), ["lang", "id"])
    spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    ranked = scored.join(spelt, ["lang", "phrase"]).select("lang", F.col("text").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
