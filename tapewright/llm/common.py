"""Shared plumbing: reading tables, tables kept in the shared folder, ordered shards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives the loss of an executor."""
    return kept_at(df, new_path(df.sparkSession, name))


def kept_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.kept_path = path
    return found


def remove_kept(*tables: DataFrame | None) -> None:
    """Deletes tables that `kept` wrote and no later plan reads."""
    for df in tables:
        if df is not None:
            remove_path(df.sparkSession, df.kept_path)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables kept inside go when the block ends: what is made of them has to be written by then."""
    path = new_path(spark, name)
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove_path(spark, path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside passes batches of about `most` bytes to mapInArrow's functions."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text: whatever other columns there are can't clash."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def least_hashed(df: DataFrame, bound: int, seed: int, *ties: str) -> DataFrame:
    """The `bound` rows with the least hashes of doc_id, or all if there are no more; then by `ties`.

    Rows are counted first, and only those under the hash that about `bound`
    and six deviations of them have go on to be sorted. So tasks send `bound`
    rows together, not each.
    """
    hashed = F.xxhash64("doc_id", F.lit(seed))
    share = (bound + 6 * bound**0.5 + 1) / max(df.count(), 1)
    near = df.where(hashed < F.lit(int(share * 2**64) - 2**63)) if share < 1 else df
    return near.orderBy(hashed, "doc_id", *ties).limit(bound)


def in_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds `shard`: ascending ranges of the key that hold about equally many rows. Null keys come first.

    The cuts come from one pass over the key column; there are at most `shards` of them, whatever the rows.
    """
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(key, [i / shards for i in range(1, shards)], 0.25 / shards) if shards > 1 else []
    low = float("-inf")
    splits = [low, *sorted(set(cuts) - {low}), float("inf")]
    if len(splits) == 2:
        return df.withColumn("shard", F.lit(0))
    keyed = df.withColumn("_at", F.coalesce(F.col(key).cast("double"), F.lit(-1.7976931348623157e308)))
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_shard").transform(keyed).withColumn("shard", F.col("_shard").cast("int")).drop("_at", "_shard")


def whole_row(df: DataFrame, names: list[str]) -> Column:
    """The row as one value, so that columns beside it can't clash with its own."""
    return F.struct(*[F.col(quoted(c)) for c in names])


def field(row: str, name: str) -> Column:
    """A column of a whole row, whatever its name."""
    return F.col(row).getField(name).alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
