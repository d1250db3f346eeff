"""Operator 1, document fingerprints: one-permutation MinHash.

Every shingle of five words (lower case A-Z; a shorter text is one shingle) is
hashed once. The top bits of a hash choose one of BINS bins, and a bin keeps
its least hash. An empty bin takes the value of a filled one, found by probing
bins in an order that depends on the bin alone (optimal densification), so that
two texts that share the donor agree. Of each value the low BITS bits are kept.
Two unrelated values agree with probability 2^-BITS, which `likeness` takes off.

Null and empty texts, and those without words, have the fingerprint '' and are
like each other (1.0) and like nothing else (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import spans
from tapewright.llm.common import document_text, in_shards, partitions

BINS, BITS, WIDTH = 256, 8, 5

_START, _STEP = (spans.mixed(np.arange(2 * BINS, dtype=np.uint64)).reshape(2, BINS) >> np.uint64(40)).astype(np.int64)
_STEP |= 1  # odd, so that a bin's probes meet every bin


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """values with every empty bin filled; each row has a filled bin."""
    out = values.copy()
    rows, bins = np.nonzero(~filled)
    flat_filled, flat_values = filled.ravel(), values.ravel()
    row_at, donor = rows * BINS, _START[bins] % BINS
    while len(rows):
        good = flat_filled[row_at + donor]
        out[rows[good], bins[good]] = flat_values[(row_at + donor)[good]]
        rows, bins, row_at, donor = (x[~good] for x in (rows, bins, row_at, donor))
        donor = (donor + _STEP[bins]) % BINS
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of BINS bytes for each text, and a last column that is 0 for texts without words."""
    out = np.zeros((len(texts), BINS + 1), np.uint8)
    for first, last, data, at in spans.chunks(texts):
        data = spans.LOWER[data]
        starts, ends, n = spans.words(data, at)
        found, count = spans.shingles(spans.hashes(data, starts, ends), n, WIDTH)
        row = np.repeat(np.arange(last - first), count)
        order = np.argsort(found, kind="stable")[::-1]  # the least is written last
        values = np.zeros((last - first, BINS), np.uint64)
        filled = np.zeros((last - first, BINS), bool)
        place = row[order], (found[order] >> np.uint64(56)).astype(np.int64)
        values[place] = found[order]
        filled[place] = True
        full = count > 0
        if full.any():
            out[first:last][full, :BINS] = (densified(values[full], filled[full]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        out[first:last, BINS] = full
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, 0 to 1, free of the bias of the low bits."""
    chance = 2.0**-BITS
    same = (a[:, :BINS] == b[:, :BINS]).mean(axis=1)
    both, either = (a[:, BINS] & b[:, BINS]) > 0, (a[:, BINS] | b[:, BINS]) > 0
    return np.where(both, np.clip((same - chance) / (1 - chance), 0, 1), np.where(either, 0.0, 1.0))


def as_text(prints: np.ndarray) -> list[str]:
    return [x[:BINS].tobytes().hex() if x[BINS] else "" for x in prints]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each document, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(as_text(fingerprints(batch["text"])), pa.string())], ["doc_id", "fingerprint"])

    return document_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, document and text; each but the first of a shard is the next one of the row before."""
    held: tuple | None = None  # the last row seen, which waits for its next one
    for batch in batches:
        texts = batch["text"]
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)) if pa.types.is_string(texts.type) else np.full(len(texts), 4096)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // (4 * spans.CHUNK_BYTES), prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            rows = list(zip(part["shard"].to_pylist(), part["ahead"].to_pylist(), part["doc_id"].to_pylist(), [x or "" for x in part["text"].to_pylist()], strict=True))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            if len(rows) < 2:
                continue
            own = fingerprints(pa.array([r[3] for r in rows], pa.large_string()))
            # A row that is only there to be the next one, and the last row of a shard that has none, make no row of their own.
            use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not use:
                continue
            edited = []
            for i in use:
                text, q = rows[i][3], len(rows[i][3]) // 4
                edited.append(text[: len(text) - q] + rows[i + 1][3][:q])
            theirs = fingerprints(pa.array(edited, pa.large_string()))
            mine, after = own[use], own[[i + 1 for i in use]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in use], pa.int64()),
                    pa.array([len(rows[i][3]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(as_text(mine), pa.string()),
                    pa.array(as_text(theirs), pa.string()),
                    pa.array(likeness(mine, theirs)),
                    pa.array(likeness(mine, after)),
                ],
                [x.split()[0] for x in _NEXT.split(", ")],
            )


def fingerprint_edits(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter replaced by the start of the next
    document's text, by ascending doc_id; after the last comes the first. Null
    ids come first, and rows that repeat an id come in the order of their
    texts. A document that is alone is its own next one.

    Texts are shuffled once, by ranges of ids. The first row of each range is
    also sent to the range before it, so no range waits for another.
    """
    spark = docs.sparkSession
    rows = in_shards(document_text(docs).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", shards or 4 * partitions(spark))
    least = -(1 << 63)
    keyed = rows.withColumn("_key", F.coalesce("doc_id", F.lit(least)))
    firsts = sorted((r[0], r[1]) for r in keyed.groupBy("shard").agg(F.min("_key")).collect())  # one row for each shard
    ahead = spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "_first long, _to int")
    joined = keyed.join(F.broadcast(ahead), keyed["_key"] == ahead["_first"], "left")
    # A row that is ahead in its own shard (there is but one) must sort after all others: `turn`.
    places = F.array(F.struct(F.col("shard").alias("shard"), F.lit(False).alias("ahead")), F.struct(F.col("_to").alias("shard"), F.lit(True).alias("ahead")))
    sent = joined.withColumn("place", F.explode(places)).where("place.shard is not null").select("place.shard", "place.ahead", "doc_id", "text")
    ordered = sent.repartition("shard").sortWithinPartitions("shard", "ahead", F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(_with_next, _NEXT)
