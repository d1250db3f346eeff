"""Operator 2, near-duplicates: bottom-k sketches from one hash function.

1. A document is its set of distinct shingle hashes. Documents with equal sets
   are one class from here on, named by the least doc_id.
2. Inverted lists hold the documents that retain the same values. Single values
   of short shingles are in every other document, so a list's key is a run of
   RUN values that follow each other in the order of the hash. The shingles
   that a pair doesn't share cut the circle of all its values into runs; at a
   likeness of 0.8 one of these has RUN values at least, and a fifth of the keys
   or more are shared. Sets of up to AROUND values have all circular runs as
   keys, so a pair with a set of up to WHOLE (its partner then has up to AROUND)
   is never missed. Larger sets have the runs inside their REACH least values
   whose first value is divisible by a power of two that grows with the set
   (see `step`); a pair right at 0.8 then shares none, or only one, with a
   chance below 1e-12, at 0.85 below 1e-18.
3. Since a pair shares so many keys, a document leaves its longest lists: a
   fifth of its keys less one, for sets above WHOLE one. A pair still meets in
   the lists that are left, and documents that share a passage only are out.
4. Each list gives the pairs with its hub, the document in most lists. Their
   likeness is estimated from the least values of both sketches' union, clearly
   lower pairs go, and exact Jaccard on the full sets confirms the others:
   100 * common >= 80 * union. Links are joined to components.
5. Lists whose other documents are still of several components are gathered by
   the hub's component. Documents outside that component are compared, in
   blocks of matrices, with all of the gathered ones; what is left goes through
   estimate and exact test. So no list is cut short, and copies of one text
   cost a pair or two each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import document_text, kept, remove_kept
from tapewright.llm.components import components

SKETCH, RUN, REACH = 128, 4, 512
WHOLE, AROUND = 128, 160
#: In step 5 sets of fewer than LOOK values are compared whole; others pass from LOOK_LEAST of their LOOK least values in common (6 deviations).
LOOK, LOOK_LEAST = 1024, 742
LEFT, RIGHT = 256, 1024
#: The estimate drops a pair with fewer than LEAST of SKETCH values in common; at a likeness of 0.8 that many are missing once in hundred millions (6 deviations).
LEAST = 75


def step(n: int) -> int:
    """Of the runs of a set of n values, those are keys whose first value is divisible by this."""
    return 1 if n <= 224 else 2 if n <= 384 else 4


def run_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the lists that a document is in; values: its sorted distinct shingle hashes."""
    if len(values) < RUN:  # alike only to equal sets
        return values[:0]
    if len(values) <= AROUND:
        around, n = np.concatenate([values, values[: RUN - 1]]), len(values)
    else:
        around = values[:REACH]
        n = len(around) - RUN + 1
    keys = around[:n] * spans._PLACES[0]
    for j in range(1, RUN):
        keys += around[j : j + n] * spans._PLACES[j]
    if (every := step(len(values))) > 1:
        keys = keys[around[:n] % np.uint64(every) == 0]
    return np.unique(spans.mixed(keys) >> np.uint64(8))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _set_names(sets: list[np.ndarray]) -> list[pa.Array]:
    a = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
    b = np.array([np.bitwise_xor.reduce(spans.mixed(x + spans._PLACES[7])) if len(x) else 0 for x in sets], np.uint64)
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]


def list_keys(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (distinct shingles), two hashes of the whole set, and keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in spans.shingle_sets(batch["text"], width):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(sets)), *_set_names(sets), _lists([run_keys(x) for x in sets])], ["doc_id", "n", "set_a", "set_b", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in spans.shingle_sets(batch["text"], width):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(sets)), *_set_names(sets), _lists(sets)], ["doc_id", "n", "set_a", "set_b", "values"])

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, values array<long>")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def estimate(x: np.ndarray, y: np.ndarray) -> int:
    """0: not alike; 1: may be; 2: alike, as both sketches are whole sets."""
    common = np.intersect1d(x, y, assume_unique=True)
    if len(x) < SKETCH and len(y) < SKETCH:
        return 2 if 100 * len(common) >= 80 * (len(x) + len(y) - len(common)) else 0
    union = np.union1d(x, y)[:SKETCH]
    return int(int(np.searchsorted(common, union[-1], side="right")) * SKETCH >= LEAST * len(union))


def alike(x: np.ndarray, y: np.ndarray) -> int:
    """Exact: both are whole sets."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 2 if 100 * common >= 80 * (len(x) + len(y) - common) else 0


def _judged(pairs: DataFrame, arrays: DataFrame, test) -> DataFrame:
    """Rows (a, b, verdict) whose two arrays pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = np.array([test(x, y) for x, y in zip(_arrays(batch["of_a"]), _arrays(batch["of_b"]), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(verdict)], ["a", "b", "verdict"]).filter(pa.array(verdict > 0))

    both = pairs.select("a", "b").join(arrays.toDF("a", "of_a"), "a").join(arrays.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(run, "a long, b long, verdict int")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of document ids that are alike; sets: doc_id, values, sketch."""
    likely = kept(_judged(pairs, sets.select("doc_id", "sketch"), estimate), "likely")
    exact = _judged(likely.where("verdict = 1"), sets.select("doc_id", "values"), alike)
    links = kept(likely.where("verdict = 2").unionByName(exact).select("a", "b"), "links")
    remove_kept(likely)
    return links


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes allow a link, the less id first."""
    sized = pairs.where("a <> b and 100 * least(an, bn) >= 80 * greatest(an, bn)")
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_lists(lists: DataFrame, doc: DataFrame, hubs: DataFrame) -> DataFrame:
    """doc_id, gathered: the documents of the lists that hold several components besides the hub, by the hub's component.

    doc: a row for each document with its component, n and keys; labels are
    joined there, before the keys are laid out.
    """
    laid = doc.select("doc_id", "component", F.explode("keys").alias("key"))
    several = laid.join(hubs, "key").where("doc_id <> hub").groupBy("key", "hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "hub")
    gathered = several.join(doc.select(F.col("doc_id").alias("hub"), F.col("component").alias("gathered")), "hub").select("key", "gathered")
    return laid.select("key", "doc_id").join(gathered, "key").select("doc_id", "gathered").distinct()


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, an, b, bn) of a block's two sides, of different components, that are alike or may be.

    Pairs of whole sets are decided here: `sure` is true, and for a document and
    a component one of them is enough.
    """
    left, right = block[block.side == 0], block[block.side == 1]
    none = pd.DataFrame({"a": [], "an": [], "b": [], "bn": [], "sure": []}).astype({"a": "int64", "an": "int64", "b": "int64", "bn": "int64", "sure": "bool"})
    if not len(left) or not len(right):
        return none
    arrays = [*left.low, *right.low]
    sizes = np.array([len(x) for x in arrays])
    _, place, times = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    column = np.full(len(times), -1)
    column[times > 1] = np.arange(int((times > 1).sum()))
    row, col = np.repeat(np.arange(len(sizes)), sizes), column[place]
    row, col, k = row[col >= 0], col[col >= 0], len(left)
    common = np.zeros((k, len(right)), np.float32)
    for low in range(0, int((times > 1).sum()), 4096):  # columns by the thousand: the table of values stays small
        here = (col >= low) & (col < low + 4096)
        held = np.zeros((len(sizes), 4096), np.float32)
        held[row[here], col[here] - low] = 1
        common += held[:k] @ held[k:].T
    a, b = sizes[:k, None], sizes[None, k:]
    whole = (a < LOOK) & (b < LOOK)
    an, bn = left.n.to_numpy(), right.n.to_numpy()
    fits = 100 * np.minimum(an[:, None], bn[None, :]) >= 80 * np.maximum(an[:, None], bn[None, :])
    good = fits & np.where(whole, 100 * common >= 80 * (a + b - common), common >= LOOK_LEAST) & (left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :])
    x, y = np.nonzero(good)
    if not len(x):
        return none
    pairs = pd.DataFrame({"a": left.doc_id.to_numpy()[x], "an": an[x], "b": right.doc_id.to_numpy()[y], "bn": bn[y], "of_b": right.component.to_numpy()[y], "sure": whole[x, y]})
    sure = pairs[pairs.sure].sort_values(["a", "b"]).drop_duplicates(["a", "of_b"])
    return pd.concat([sure, pairs[~pairs.sure]])[["a", "an", "b", "bn", "sure"]]


def _dealt(to: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(to), blocks).cast("int")


def between_components(rows: DataFrame, doc: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, an, b, bn, sure) of gathered documents: those outside the gathering component against all."""
    low = sets.select("doc_id", F.slice("values", 1, LOOK).alias("low"))
    held = rows.join(doc.select("doc_id", "component", "n"), "doc_id")
    outside = F.col("component") != F.col("gathered")
    sizes = held.groupBy("gathered").agg(F.ceil(F.sum(outside.cast("int")) / LEFT).cast("int").alias("lefts"), F.ceil(F.count("*") / RIGHT).cast("int").alias("rights")).where("lefts > 0")
    held = held.join(kept(sizes, "sizes"), "gathered")  # written, so that its size is known and a large group needn't meet in one task
    lefts = held.where(outside).withColumn("i", _dealt("doc_id", F.col("lefts"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("side", F.lit(0))
    rights = held.withColumn("j", _dealt("doc_id", F.col("rights"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    columns = ["gathered", "i", "j", "side", "doc_id", "component", "n"]
    sides = lefts.select(*columns).unionByName(rights.select(*columns)).join(low, "doc_id")
    return sides.groupBy("gathered", "i", "j").applyInPandas(_block_links, "a long, an long, b long, bn long, sure boolean")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    component_id is the least doc_id that links reach. A null or empty text, or
    one without words, has no shingles and stands alone. Rows that repeat an id
    count as one document: equal texts are one class, and of different ones the
    set with the least hash stands for the id in links; the others keep their
    class. A null id can't be linked: its component_id is null and it is kept.
    An empty table gives an empty one.
    """
    texts = document_text(docs)
    prints = kept(list_keys(texts, width), "prints")
    linked = prints.where("n > 0 and doc_id is not null")
    classes = kept(linked.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    # One row for each document that stands for a class; of rows that repeat its id, the least set.
    one = linked.join(reps, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n", "keys")).alias("own")).select("doc_id", "own.*")
    one, ids = kept(one, "ones"), kept(prints.select("doc_id", "n", "set_a", "set_b"), "ids")
    remove_kept(prints)
    listed = one.select("doc_id", F.explode("keys").alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = listed.join(sizes, "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("met"))
    met = met.join(one.select("doc_id", "n", "set_a", "set_b"), "doc_id")
    leave = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * 0.2) - 1).otherwise(1)
    stay = F.slice("met", F.lit(1), F.greatest(F.size("met") - leave, F.lit(0)).cast("int"))
    doc = kept(met.select("doc_id", "n", "set_a", "set_b", F.transform(stay, lambda m: m["key"]).alias("keys")).where("size(keys) > 0"), "listed")
    remove_kept(one)

    full = full_sets(texts.join(doc.select("doc_id"), "doc_id", "left_semi"), width)
    full = full.join(doc.select("doc_id", "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id"])  # rows that are left for an id have one set
    sets = kept(full.select("doc_id", "values", F.slice("values", 1, SKETCH).alias("sketch")), "sets")

    laid = doc.select("doc_id", "n", F.size("keys").alias("score"), F.explode("keys").alias("key"))
    best = laid.groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"), "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = kept(best.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    stars = laid.join(hubs, "key").select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("hub").alias("b"), F.col("hub_n").alias("bn"))
    links = confirmed(_ordered(stars), sets)
    label = components(links)

    named = doc.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = kept(named.select("doc_id", "n", "component", "keys"), "named")
    rows = kept(open_lists(laid, named, hubs.select("key", "hub")), "open")
    if not rows.isEmpty():
        found = kept(between_components(rows, named, sets), "between")
        more = confirmed(_ordered(found.where("not sure")), sets)
        label = components(links.unionByName(found.where("sure").select("a", "b")).unionByName(more))
        remove_kept(found, more)
    remove_kept(doc, sets, hubs, links, named, rows)

    of_class = classes.join(label, classes["rep"] == label["node"], "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    out = ids.join(of_class, ["set_a", "set_b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
