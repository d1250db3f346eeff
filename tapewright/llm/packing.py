"""Operator 9, best-fit packing into sequences of CAPACITY tokens.

Pieces above a third of a sequence pair at most twice in one: the largest
takes the largest partner that still fits. Smaller ones, by falling length, go
where they leave the smallest gap. Pieces are dealt by hash into groups of
about GROUP, which are packed on their own; what they leave open is packed
together.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import document_text, kept, remove_kept
from tapewright.llm.subwords import default_path, encoded

CAPACITY, GROUP, END = 2048, 20_000, 0


def with_end(ids: np.ndarray, n: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """ids of several texts with the end after each, and where each begins (one more than texts)."""
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(at[-1]), end, "<u4")
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = ids
    return out, at


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and its end, the last pieces full, the first what is left."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, n in encoded(batch["text"], path):
                flat, at = with_end(ids, n)
                sizes = np.diff(at)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = (sizes - (count - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                begin = (at[:-1][row] + start).tolist()
                crc = [zlib.crc32(flat[a : a + m]) for a, m in zip(begin, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return document_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_length: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        by_length[int(lengths[i])].append(i)
    large = sum(1 << size for size in by_length if 3 * size > capacity)
    gaps: dict[int, list[int]] = defaultdict(list)  # gap -> sequences that have it
    open_gaps, made = 0, 0

    def take(size: int) -> int:
        nonlocal large
        i = by_length[size].pop()
        if not by_length[size]:
            large &= ~(1 << size)
        return i

    while large:
        size = large.bit_length() - 1
        sequence[take(size)] = made
        left = capacity - size
        fits = large & ((1 << (left + 1)) - 1)
        if fits:
            other = fits.bit_length() - 1
            i = take(other)
            sequence[i], offset[i] = made, size
            left -= other
        if left:
            gaps[left].append(made)
            open_gaps |= 1 << left
        made += 1
    for size in sorted((s for s in by_length if 3 * s <= capacity), reverse=True):
        for i in by_length[size]:
            fits = open_gaps >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                bin_ = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
            else:
                gap, bin_, made = capacity, made, made + 1
            sequence[i], offset[i] = bin_, capacity - gap
            if gap > size:
                gaps[gap - size].append(bin_)
                open_gaps |= 1 << (gap - size)
    return sequence, offset


def _dealt(items: DataFrame, columns: list[str]) -> DataFrame:
    """items with g: groups of about GROUP rows by hash of the id columns; rows that repeat more often than half a group holds are dealt by their place in the table, too."""
    sizes = items.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    groups = -(-(sizes.n or 0) // GROUP) or 1
    place = [F.monotonically_increasing_id()] if (sizes.most or 0) > GROUP // 2 else []
    return items.withColumn("g", F.pmod(F.xxhash64(*columns, *place, F.lit(3)), F.lit(groups)))


def _packed(items: DataFrame, capacity: int, columns: list[str]) -> DataFrame:
    """items (id columns, length) with sequence and offset, packed in groups."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(columns, kind="stable")
        sequence, offset = pack(group["length"].to_numpy(), capacity)
        return group.assign(sequence=sequence + (int(group["g"].iloc[0]) << 32), offset=offset).drop(columns="g")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return _dealt(items, columns).groupBy("g").applyInPandas(run, f"{schema}, sequence long, offset long")


def best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A null or empty text is one piece, its end. Rows that repeat are packed
    each; an empty table gives an empty one. Every text is encoded once and not
    shuffled; only pieces are.

    Groups are packed on their own. Then the sequences that are at most half
    full, about one of each group, are packed again as if they were pieces, in
    rounds until one group holds them; so groups cost no sequences.
    """
    found = kept(pieces(docs, tokenizer, capacity), "pieces")
    placed = kept(_packed(found, capacity, ["doc_id", "piece", "ids_crc32"]).withColumn("level", F.lit(0)), "packed")
    level = before = 0
    while True:
        loads = placed.groupBy("level", "sequence").agg(F.sum("length").alias("length")).where(F.col("length") <= capacity // 2)
        loads = kept(loads, "open")
        n = loads.count()
        if n < 2 or level and n >= before:
            break
        level, before = level + 1, n
        moved = _moves(loads, capacity)
        met = placed.join(moved, (F.col("level") == F.col("of_level")) & (F.col("sequence") == F.col("of")), "left")
        there = F.col("to").isNotNull()
        new = met.select("doc_id", "piece", "start", "length", "ids_crc32", F.when(there, F.col("to")).otherwise(F.col("sequence")).alias("sequence"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), F.when(there, F.lit(level)).otherwise(F.col("level")).alias("level"))
        old, placed = placed, kept(new, "packed")
        remove_kept(old)
        if n <= GROUP:
            break
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.shiftleft(F.col("level").cast("long"), 56)).alias("sequence_id"), "offset")


def _moves(loads: DataFrame, capacity: int) -> DataFrame:
    """of_level, of (a sequence), to, base: where the sequences go that are packed again."""
    items = loads.toDF("of_level", "of", "length")
    return kept(_packed(items, capacity, ["of_level", "of"]).select("of_level", "of", F.col("sequence").alias("to"), F.col("offset").alias("base")), "moves")
