"""The same folds over streams: bars, sessions, dedupe, order state, joins, upserts.

Every function takes a streaming (or batch) DataFrame and returns one, so that
one definition serves both; `drain` runs a query over all that is there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Appends all that closes to a table and reads it."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def minute_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """OHLCV of each minute; a minute is final once the watermark has passed it."""
    at = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return g.select(F.col("window.start").alias("minute_start"), "symbol", "open", "high", "low", "close", "volume")


def sliding_activity(ticks: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Prints and volume of overlapping windows."""
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", size, step), "symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    return g.select(F.col("window.start").alias("window_start"), "symbol", "n", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap longer than `gap`."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "user_id", "n")


def late_rows(rows: DataFrame, late_seconds: int, ties: Sequence[str] = ()) -> DataFrame:
    """How many rows a watermark would have dropped, recounted in batch by day of arrival. rows: day, arrival, ts; rows of one arrival come in the order of `ties`."""
    from pyspark.sql import Window as W

    seen = F.max("ts").over(W.partitionBy("day").orderBy("arrival", *ties).rowsBetween(W.unboundedPreceding, -1))
    late = F.coalesce(F.col("ts") < seen - F.expr(f"INTERVAL {late_seconds} SECOND"), F.lit(False))
    return rows.withColumn("late", late).groupBy("day").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


def late_in_stream(batches: DataFrame, late: str, checkpoint: str, key: str = "event_id") -> DataFrame:
    """One row: the batches of a running stream, its rows, and how many its watermark dropped, by the query's own progress.

    batches: a stream with `ts` and a key, in the order of arrival. The rows go
    through a keyed state, which counts each row that is behind the watermark.
    """
    spark = batches.sparkSession
    running = batches.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    query = running.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p.numInputRows]  # a row for each batch
    dropped = sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)
    return spark.createDataFrame([(len(steps), sum(p.numInputRows for p in steps), dropped)], "n_batches long, n long, n_late long")


def late_by_batch(rows: DataFrame, late: str) -> DataFrame:
    """The batch recount: rows at or before the watermark that the batch before theirs ran with. rows: batch, ts.

    A watermark follows a batch's largest time less the delay, and takes effect
    for late rows one batch later.
    """
    from pyspark.sql import Window as W

    ends = rows.groupBy("batch").agg(F.max("ts").alias("end"))  # a row for each batch
    mark = F.max("end").over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -2)) - F.expr(f"INTERVAL {late}")
    marked = rows.join(F.broadcast(ends.select("batch", mark.alias("mark"))), "batch")
    return marked.agg(F.count_distinct("batch").alias("n_batches"), F.count("*").alias("n"), F.count_if(F.col("ts") <= F.col("mark")).alias("n_late"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first of each key inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def reconcile_streams(bars: DataFrame, ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Minute volumes of two streams side by side.

    bars: minute_start, symbol, bar_volume; ticks: tick_start, tick_symbol, tick_volume.
    """
    b, t = bars.withWatermark("minute_start", late), ticks.withWatermark("tick_start", late)
    return b.join(t, (b["symbol"] == t["tick_symbol"]) & (b["minute_start"] == t["tick_start"]), "inner").select("minute_start", "symbol", "bar_volume", "tick_volume")


def _versions(spark: SparkSession, top: str) -> list[tuple[int, int, int, str]]:
    """(epoch, buckets, bucket, path) of each bucket that a finished epoch has written. The driver holds a row for each; compaction bounds them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = {s.getPath().getParent().toString() for s in fs.globStatus(hadoop.Path(f"{top}/_epoch=*/_buckets=*/_SUCCESS")) or []}
    out = []
    for status in fs.globStatus(hadoop.Path(f"{top}/_epoch=*/_buckets=*/_bucket=*")) or []:
        path = status.getPath()
        if path.getParent().toString() in done:
            out.append((*(int(p.getName().split("=")[1]) for p in (path.getParent().getParent(), path.getParent(), path)), path.toString()))
    return out


def _latest(versions: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The last version of each bucket. A table that was dealt into more buckets was written whole, so that those of fewer are void."""
    buckets = max((n for _, n, _, _ in versions), default=0)
    last = {}
    for v in sorted(v for v in versions if v[1] == buckets):
        last[v[2]] = v
    return list(last.values())


def _read(spark: SparkSession, top: str, versions: list[tuple[int, int, int, str]]) -> DataFrame:
    return spark.read.option("basePath", top).parquet(*(path for *_, path in versions)).drop("_epoch", "_buckets", "_bucket")


def upserted(spark: SparkSession, top: str, before: int | None = None) -> DataFrame | None:
    """The table that an upsert sink keeps under `top`: each bucket as the last epoch that touched it wrote it; None if there is none yet."""
    last = _latest([v for v in _versions(spark, top) if before is None or v[0] < before])
    return _read(spark, top, last) if last else None


def compact(spark: SparkSession, top: str, before: int, keep: int = 2) -> int:
    """Deletes what epochs before `before` wrote and later ones replaced, but for the `keep` last versions of a bucket; the number of versions deleted.

    Epochs before the one at work never run again, so a restart needs their
    last versions only; the others are for readers that listed the table earlier.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    versions = sorted((v for v in _versions(spark, top) if v[0] < before), reverse=True)
    dealt, seen, gone, held = {n for _, n, _, _ in versions}, Counter(), [], set()
    for epoch, buckets, bucket, path in versions:
        seen[buckets, bucket] += 1
        # A table that was dealt into more buckets replaces each of fewer once.
        if seen[buckets, bucket] + sum(n > buckets for n in dealt) > keep:
            gone.append((epoch, path))
        else:
            held.add(epoch)
    for epoch, path in gone:
        p = hadoop.Path(path)
        p.getFileSystem(conf).delete(p if epoch in held else p.getParent().getParent(), True)
    return len(gone)


def upsert_to(top: str, keys: list[str], buckets: int = 16, bucket_rows: int = 5_000_000, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key.

    An epoch writes the buckets of keys that it touches, whole, to a folder of
    its own and reads none of its own, so one that runs again writes the same.
    All state is in the folder: a restarted query goes on from it. A table of
    more than `bucket_rows` rows a bucket is dealt anew into twice as many, as
    often as it takes, so that an epoch rewrites little around the keys it
    touches; versions that are replaced go, but for `keep`.
    """

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = _latest([v for v in _versions(spark, top) if v[0] < epoch])
        n = last[0][1] if last else buckets
        new = batch.persist()
        try:
            if coming := new.count():
                old = _read(spark, top, last) if last else None
                rows = coming + (old.count() if last else 0)  # stored rows are counted from the files' footers
                many = n
                while rows > many * bucket_rows:
                    many *= 2
                merged = dealt(new, many)
                if many == n and last:
                    touched = {r[0] for r in merged.select("_bucket").distinct().collect()}  # at most n numbers
                    last = [v for v in last if v[2] in touched]
                    old = _read(spark, top, last) if last else None
                if old is not None:
                    named = new.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
                    stay = old.join(named, reduce(and_, (old[k].eqNullSafe(named[f"_new_{k}"]) for k in keys)), "left_anti")
                    merged = dealt(stay, many).unionByName(merged)
                merged.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{top}/_epoch={epoch}/_buckets={many}")
        finally:
            new.unpersist()
        compact(spark, top, epoch, keep)

    return sink


def drain_updates(stream: DataFrame, top: str, keys: list[str], checkpoint: str) -> DataFrame:
    """Runs an updating aggregation into the upsert sink over all that is there."""
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert_to(top, keys)).trigger(availableNow=True).start().awaitTermination()
    found = upserted(stream.sparkSession, top)
    return stream.sparkSession.createDataFrame([], stream.schema) if found is None else found.select(*stream.columns)
