"""Reading, replacing and upserting stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; only a local session may leave spark.checkpoint.dir unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `shared_path` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go when its write ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scan_bars(spark: SparkSession, path: str, session: str, date: str, columns: Sequence[str], first: int, last: int) -> DataFrame:
    """One partition, some columns, a range of stamps; all three reach the scan."""
    t = spark.read.parquet(path).where((F.col("session") == session) & (F.col("snapshot_date") == F.lit(date).cast("date")))
    return t.where(F.col("ts_hms").between(first, last)).select(*columns)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: a folder for each session and date, sorted by stamp inside, so that ranges of stamps prune row groups."""
    bars.repartition("session", "snapshot_date").sortWithinPartitions("ts_hms", "symbol").write.mode(mode).partitionBy("session", "snapshot_date").parquet(path)


def lookback(panel: DataFrame, columns: Sequence[str], days: int = 200) -> DataFrame:
    """The last calendar days of a table."""
    last = panel.agg(F.max("date").alias("_last"))
    return panel.select("date", *columns).crossJoin(F.broadcast(last)).where(F.col("date") > F.date_sub("_last", days)).drop("_last")


def replace_symbols(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("snapshot_date", "symbol")) -> DataFrame:
    """Rows of symbols that come in are replaced as a whole."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def shrink_guard(stored: DataFrame, new: DataFrame, allow: DataFrame | None = None, keys: Sequence[str] = ("snapshot_date", "symbol")) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows in quarantine): a replacement with fewer rows than stored is refused, unless allowed."""
    a, b = stored.groupBy(*keys).agg(F.count("*").alias("n_old")), new.groupBy(*keys).agg(F.count("*").alias("n_new"))
    refused = b.join(a, list(keys)).where("n_new < n_old")
    if allow is not None:
        refused = refused.join(allow.select(*keys).distinct(), list(keys), "left_anti")
    return new.join(refused.select(*keys), list(keys), "left_anti"), new.join(refused, list(keys))


def remove_symbols(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """S8"""
    return stored.join(gone.select("symbol").distinct(), "symbol", "left_anti")


def upsert_last_wins(stored: DataFrame, new: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """S9"""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(arrival))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def replace_dates(stored: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """Whole dates are replaced; the dates are few and can be sent."""
    return stored.join(new.select(date).distinct(), date, "left_anti").unionByName(new)


def append_newer(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after each symbol's last stored date; unknown symbols come whole."""
    last = stored.groupBy("symbol").agg(F.max("date").alias("_last"))
    return new.join(last, "symbol", "left").where("_last is null or date > _last").drop("_last")


def new_dates(cal: DataFrame, panel: DataFrame, today: str) -> DataFrame:
    """Sessions after the panel's last date up to today."""
    last = panel.agg(F.max("date").alias("_last"))
    return cal.select("date").crossJoin(F.broadcast(last)).where((F.col("date") > F.col("_last")) & (F.col("date") <= F.lit(today).cast("date"))).drop("_last")


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Raw responses with the file each came from."""
    return spark.read.schema("run_id string, attempt_index int, payload string").json(path).withColumn("path", F.col("_metadata.file_path"))


def ledger_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are left out."""
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    return rows.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def row_digest(columns: Sequence[str]) -> Column:
    """128 bits of a row's values, each with its place and whether it is null."""
    whole = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns))))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def make_patch(base: DataFrame, now: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(changed or new rows, deleted keys). Values are compared column by column; NULL equals NULL alone."""
    values = [c for c in now.columns if c not in keys]
    a, b = base.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_there")), now.withColumn("_new", F.struct(*values))
    j = b.join(a, list(keys), "left")
    return j.where(F.col("_there").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))).drop("_old", "_new", "_there"), base.select(*keys).join(now.select(*keys), list(keys), "left_anti")


def apply_patch(base: DataFrame, changed: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    gone = changed.select(*keys).unionByName(deleted.select(*keys)).distinct()
    return base.join(gone, list(keys), "left_anti").unionByName(changed)


def _digest(df: DataFrame) -> Row:
    """Rows and a sum of row digests: equal for equal multisets of rows, whatever their order."""
    d = row_digest(df.columns)
    return df.agg(F.count("*").alias("rows"), *(F.sum(d[k].cast("decimal(38,0)")).cast("string").alias(k) for k in ("a", "b"))).first()


def write_base(df: DataFrame, top: str, keys: Sequence[str], date: str = "date") -> None:
    """A table as one folder for each month, rows in the order of the keys, and a manifest of each month's rows and digest.

    A table without the date column, or with a NULL date, is refused.
    """
    if date not in df.columns:
        raise ValueError(f"no {date} column")
    if df.where(F.col(date).isNull()).head(1):
        raise ValueError("a row has no date")
    month = F.year(date) * 100 + F.month(date)
    df.withColumn("_month", month).repartition("_month").sortWithinPartitions("_month", *keys).write.partitionBy("_month").parquet(f"{top}/base")
    d = row_digest(df.columns)
    listed = df.withColumn("_d", d).groupBy(month.alias("month")).agg(F.count("*").alias("rows"), *(F.sum(F.col(f"_d.{k}").cast("decimal(38,0)")).cast("string").alias(k) for k in ("a", "b")))
    listed.write.parquet(f"{top}/manifest")


def read_base(spark: SparkSession, top: str, schema: T.StructType) -> DataFrame:
    """The base files, once each month's rows and digest are as the manifest says."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_month", T.IntegerType())])).parquet(f"{top}/base")
    d = row_digest(schema.names)
    found = rows.withColumn("_d", d).groupBy(F.col("_month").alias("month")).agg(F.count("*").alias("rows"), *(F.sum(F.col(f"_d.{k}").cast("decimal(38,0)")).cast("string").alias(k) for k in ("a", "b")))
    listed = spark.read.parquet(f"{top}/manifest")
    off = listed.join(found, ["month", "rows", "a", "b"], "left_anti").select("month").unionByName(found.join(listed, ["month", "rows", "a", "b"], "left_anti").select("month"))
    first = off.orderBy("month").first()
    if first is not None:
        raise ValueError(f"month {first.month} isn't as the manifest says")
    return rows.select(*schema.names)


def write_patch(now: DataFrame, top: str, keys: Sequence[str], number: int) -> None:
    """What the base lacks of `now`: changed and new rows, deleted keys, and the digest that a rebuild must give."""
    changed, deleted = make_patch(read_base(now.sparkSession, top, now.schema), now, keys)
    changed.write.parquet(f"{top}/patch={number}/rows")
    deleted.write.parquet(f"{top}/patch={number}/deletes")
    whole = _digest(now)
    now.sparkSession.createDataFrame([(whole.rows, whole.a, whole.b)], "rows long, a string, b string").write.parquet(f"{top}/patch={number}/manifest")


def rebuilt(spark: SparkSession, top: str, keys: Sequence[str], schema: T.StructType, number: int) -> DataFrame:
    """Base and patch put together, proven equal to the table that the patch was made of, as a multiset of rows."""
    at = f"{top}/patch={number}"
    key_schema = T.StructType([schema[k] for k in keys])
    out = apply_patch(read_base(spark, top, schema), spark.read.schema(schema).parquet(f"{at}/rows"), spark.read.schema(key_schema).parquet(f"{at}/deletes"), keys).select(*schema.names)
    if tuple(_digest(out)) != tuple(spark.read.parquet(f"{at}/manifest").select("rows", "a", "b").first()):
        raise ValueError(f"patch {number} doesn't give the table it was made of")
    return out


def ladder_rows(rows: DataFrame) -> DataFrame:
    """Order-book payloads as a map with its best levels typed."""
    m = F.from_json("payload", "map<string,string>")
    return rows.withColumn("book", m).withColumn("ask1", F.element_at("book", "askp1").cast("double")).withColumn("bid1", F.element_at("book", "bidp1").cast("double"))


def write_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """S17"""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


DOWNCAST: Mapping[str, str] = {"open": "float", "high": "float", "low": "float", "close": "float", "volume": "long", "rank": "int"}


def downcast(df: DataFrame, types: Mapping[str, str] = DOWNCAST) -> DataFrame:
    """S18"""
    return df.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns))


def archive_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard order; columns that aren't there are NULL; codes filled with zeros."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).withColumn("symbol", F.lpad("symbol", 6, "0"))


def latest_archive(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date")


def day_roster(cohort: DataFrame, research: DataFrame, held: DataFrame) -> DataFrame:
    """Names of the day from any of the three, with where they come from."""
    parts = [d.select("symbol").distinct().withColumn("src", F.lit(n)) for d, n in ((cohort, "cohort"), (research, "research"), (held, "held"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"))
