"""Operator 4, token ids in files of shuffled planes.

A file holds the ids of many documents in order. Blocks of BLOCK ids are
transposed into planes: by bytes (4 planes) or by bits (32 planes). Each plane
is compressed with zstandard on its own, and the head has an index of blocks,
so that a span of ids is read from its blocks alone.

    magic, 6 bytes | length of the head, u32 | head, JSON | documents, zstandard
    | planes of block 0 | planes of block 1 ...

head: n_ids, n_docs, block, planes, documents (bytes), blocks: the lengths of
each block's planes. documents: n_docs ids as i64, n_docs flags (0: the id is
null) as u8, n_docs counts of ids as u32. All numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import document_text, in_shards, kept, new_path, partitions
from tapewright.llm.packing import with_end
from tapewright.llm.subwords import default_path, encoded

MAGIC, BLOCK, MOST_IDS = b"PLANE1", 1 << 16, 8 << 20


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block, the lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def to_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, planes: str = "byte", block: int = BLOCK) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1)
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is not None for x in doc_ids) + np.asarray(counts).astype("<u4").tobytes()
    documents = squeeze.compress(keys)
    blocks = [[squeeze.compress(p) for p in to_planes(ids[a : a + block], planes)] for a in range(0, len(ids), block)]
    head = json.dumps({"n_ids": len(ids), "n_docs": len(doc_ids), "block": block, "planes": planes, "documents": len(documents), "blocks": [[len(p) for p in b] for b in blocks]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, documents, *(p for b in blocks for p in b)])


class PlaneFile:
    """A file's content, read block by block."""

    def __init__(self, content: bytes) -> None:
        if content[:6] != MAGIC:
            raise ValueError("not a file of planes")
        size = struct.unpack_from("<I", content, 6)[0]
        self.head = json.loads(content[10 : 10 + size])
        self.content, at = content, 10 + size
        keys = zstandard.ZstdDecompressor().decompress(content[at : at + self.head["documents"]]) if self.head["documents"] else b""
        n = self.head["n_docs"]
        there = np.frombuffer(keys, np.uint8, n, 8 * n)
        self.doc_ids = [int(x) if t else None for x, t in zip(np.frombuffer(keys, "<i8", n), there, strict=True)]
        self.counts = np.frombuffer(keys, "<u4", n, 9 * n).astype(np.int64)
        self.begins = at + self.head["documents"] + np.concatenate([[0], np.cumsum([sum(b) for b in self.head["blocks"]])]).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """ids start .. stop - 1, from the blocks that hold them."""
        block, plain = self.head["block"], zstandard.ZstdDecompressor()
        out = []
        for k in range(start // block, -(-stop // block)):
            at, planes = int(self.begins[k]), []
            for size in self.head["blocks"][k]:
                planes.append(plain.decompress(self.content[at : at + size]))
                at += size
            n = min(block, self.head["n_ids"] - k * block)
            ids = from_planes(planes, n, self.head["planes"])
            out.append(ids[max(0, start - k * block) : stop - k * block])
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _put(folder: str, name: str, content: bytes) -> None:
    """Written under another name first: whoever lists the folder sees whole files only."""
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    with files.open_output_stream(f"{path}/_{name}") as out:
        out.write(content)
    files.move(f"{path}/_{name}", f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, planes: str = "byte", shards: int | None = None, most_ids: int = MOST_IDS) -> DataFrame:
    """Writes files into folder; a row (shard, part, file, n_docs, n_ids) for each.

    Documents are in ascending order of their ids through shards and parts;
    null ids come first, rows that repeat an id follow in the order of their
    texts. Every document ends with id 0; a null text is only that. A task that
    runs again writes files of other names; those listed here count.
    """
    path = tokenizer or default_path()
    rows = in_shards(document_text(docs), "doc_id", shards or 4 * partitions(docs.sparkSession))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, docs_held, counts_held, ids_held, size = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(ids_held)
            name = f"{shard:08d}-{part:05d}-{uuid.uuid4().hex}.planes"
            _put(folder, name, to_file(docs_held, np.concatenate(counts_held), ids, planes))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "file": name, "n_docs": len(docs_held), "n_ids": len(ids)}], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for first, ids, n in encoded(batch["text"], path):
                flat, at = with_end(ids, n)
                owner, keys = batch["shard"].slice(first, len(n)).to_numpy(), batch["doc_id"].slice(first, len(n)).to_pylist()
                cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(n)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if docs_held and (owner[a] != shard or size >= most_ids):
                        yield flush()
                        part = part + 1 if owner[a] == shard else 0
                        docs_held, counts_held, ids_held, size = [], [], [], 0
                    if owner[a] != shard:
                        shard, part = int(owner[a]), 0
                    docs_held += keys[a:b]
                    counts_held.append(np.diff(at[a : b + 1]))
                    ids_held.append(flat[at[a] : at[b]])
                    size += int(at[b] - at[a])
        if docs_held:
            yield flush()

    return kept(ordered.mapInArrow(run, "shard int, part int, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document in the files of the manifest.

    Where a file begins is the sum over the shards before (a row for each
    shard) and over the parts before in its own. Each task opens the files of
    its rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    files = manifest.count()
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as content:
                    file = PlaneFile(content.read())
                ids, at = file.read(0, file.head["n_ids"]), np.concatenate([[0], np.cumsum(file.counts)])
                flat = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(base + at[:-1]), pa.array(file.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("of_shard"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("part"))), F.lit(0))
    placed = manifest.withColumn("inside", inside).join(shards, "shard").select("file", (F.col("of_shard") + F.col("inside")).alias("base"))
    return placed.repartition(min(files, 4 * partitions(spark))).mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, planes: str = "byte") -> DataFrame:
    """Writes docs to files in the shared folder and reads them back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer, planes))
