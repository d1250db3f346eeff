"""Replays of the events as streams; each equals its batch definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import bars as B
from tapewright.operators import ledgers as G
from tapewright.plans import fixtures
from tapewright.plans.oracle import BARS, TICKS, query
from tapewright.plans.store_queries import _JOURNAL, scratch
from tapewright.streaming import events as X
from tapewright.streaming import orders as O

LAST = "2099-01-01 00:00:00"  # a row after all others lets the watermark pass them; its own window stays open


def replay(spark: SparkSession, rows: DataFrame, closing: dict[str, object] | None = None, files: int = 8) -> DataFrame:
    """rows written as files and read as a stream; then a file with the closing row."""
    path = scratch(spark, "replay")
    rows.repartition(files).write.parquet(path)
    if closing is not None:
        end = rows.limit(1).select(*(F.lit(closing[c]).cast(t).alias(c) if c in closing else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
        end.write.mode("append").parquet(path)
    return X.file_stream(spark, path, rows.schema)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.ticks(spark, sf_dir)
    return t.select("event_id", "symbol", "snapshot_date", F.col("ts").cast("timestamp").alias("ts"), "price", "volume", "ts_hms")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return X.drain(stream, scratch(spark, "out"), scratch(spark, "progress"))


@query(TICKS + " SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) minute_start, symbol, arg_min(price,(ts,event_id)) AS open, max(price) high, min(price) low, arg_max(price,(ts,event_id)) AS close, CAST(sum(volume) AS BIGINT) volume FROM ticks GROUP BY 1,2")
def t1_minute_bars(spark, sf_dir):
    out = drained(spark, X.minute_bars(replay(spark, ticks(spark, sf_dir), {"ts": LAST, "symbol": "x"})))
    return out.withColumn("minute_start", F.col("minute_start").cast("timestamp_ntz"))


@query(TICKS + " SELECT w AS window_start, symbol, count(*) n, CAST(sum(volume) AS BIGINT) volume FROM (SELECT *, unnest([date_trunc('hour',ts), date_trunc('hour',ts)-INTERVAL 1 HOUR]) w FROM ticks) GROUP BY 1,2")
def t2_sliding_activity(spark, sf_dir):
    out = drained(spark, X.sliding_activity(replay(spark, ticks(spark, sf_dir), {"ts": LAST, "symbol": "x"})))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e) SELECT user_id, min(ts) AS began, count(*) n FROM g GROUP BY user_id, k")
def t2_sessions(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = drained(spark, X.sessions(replay(spark, e, {"ts": LAST, "user_id": -1}), "6 hours"))
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n")


@query("WITH a AS (SELECT CAST(ts AS DATE) AS day, ts, event_id*7919%10007 arrival, event_id FROM events), b AS (SELECT *, max(ts) OVER (PARTITION BY day ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) s FROM a) SELECT day, count(*) n, count(*) FILTER (WHERE ts < s - INTERVAL 3600 SECOND) n_late FROM b GROUP BY day")
def t3_late_rows(spark, sf_dir):
    """Numbers of arrival repeat in more than 10,007 events; the SQL leaves their order open, here they come by id."""
    e = fixtures.base(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", (F.col("event_id") * 7919 % 10007).alias("arrival"))
    return X.late_rows(e, 3600, ties=["event_id"])


_ARRIVALS = 6


@query(f"WITH a AS (SELECT ts, event_id*7919%10007%{_ARRIVALS} batch FROM events), e AS (SELECT batch, max(ts) m FROM a GROUP BY 1), w AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 240 HOUR AS mark FROM e) SELECT count(DISTINCT batch) n_batches, count(*) n, count(*) FILTER (WHERE ts <= mark) n_late FROM a JOIN w USING (batch)")
def t3_late_in_stream(spark, sf_dir):
    """The events in batches of arrival through a running stream; what its watermark dropped, by its progress."""
    e = fixtures.base(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 10007 % _ARRIVALS).alias("batch"))
    path = scratch(spark, "arrivals")
    for k in range(_ARRIVALS):
        e.where(F.col("batch") == k).coalesce(1).write.mode("append").parquet(path)
    return X.late_in_stream(X.file_stream(spark, path, e.schema, files_per_trigger=1), "240 hours", scratch(spark, "progress"))


@query(TICKS + " SELECT snapshot_date, symbol, count(*) n, max(price) high, min(price) low, CAST(sum(volume) AS BIGINT) volume FROM ticks WHERE ts_hms < 152000 GROUP BY 1,2")
def t4_running_decision(spark, sf_dir):
    t = replay(spark, ticks(spark, sf_dir)).where("ts_hms < 152000")
    running = t.groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"))
    return X.drain_updates(running, scratch(spark, "running"), ["snapshot_date", "symbol"], scratch(spark, "progress"))


@query(
    f"WITH j AS ({_JOURNAL.format(orders='orders')}), g AS (SELECT intent_id, count(*) FILTER (WHERE kind='SEND') n_sends, max(CASE WHEN kind='BROKER_STATE' THEN outcome END) fin, coalesce(max(filled),0) filled, max(CASE WHEN kind='RESULT' THEN outcome END) res FROM j GROUP BY 1) SELECT intent_id, CASE WHEN fin IS NOT NULL THEN CASE WHEN filled>=100 THEN 'FILLED' WHEN filled>0 THEN 'PARTIAL' WHEN fin='cancelled' THEN 'CANCELLED' ELSE 'UNFILLED' END WHEN res='accepted' THEN 'ACKED' WHEN res='rejected' THEN 'REJECTED' WHEN res IS NULL THEN 'UNKNOWN' ELSE 'NOT_SENT' END status, filled, n_sends FROM g"
)
def t5_order_state(spark, sf_dir):
    """Two events in three come in a first run, the others after a restart from the same progress, so that most intents wait for a while."""
    return _orders_in_two_runs(spark, sf_dir, "intent_id", "status", "filled", "n_sends")


def _orders_in_two_runs(spark: SparkSession, sf_dir: str, *columns: str, events: str = "SELECT * FROM {j}") -> DataFrame:
    o = fixtures.base(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    j = spark.sql(events, j=spark.sql(_JOURNAL, orders=o))
    first = (F.col("intent_id") + F.col("seq")) % 3 != 0
    path, top, progress = scratch(spark, "replay"), scratch(spark, "orders"), scratch(spark, "progress")
    with O.rocks_store(spark):
        for part in (j.where(first), j.where(~first)):
            part.write.mode("append").parquet(path)
            out = X.drain_updates(O.order_states(X.file_stream(spark, path, j.schema)), top, ["intent_id"], progress)
    return out.select(*columns)


# Every 19th intent has its SEND twice, every 23rd lacks its SEND, every 29th fills more than it asked for.
_BROKEN = "SELECT intent_id, seq, kind, outcome, qty, CASE WHEN intent_id%29=0 AND filled=100 THEN 250 ELSE filled END AS filled FROM {j} WHERE NOT (intent_id%23=0 AND seq=1) UNION ALL SELECT intent_id, seq, kind, outcome, qty, filled FROM {j} WHERE intent_id%19=0 AND seq=1"


@query(
    f"WITH j AS ({_JOURNAL.format(orders='orders')}), b AS ({_BROKEN.format(j='j')}), s AS (SELECT intent_id, count(*) FILTER (WHERE seq=1) n1, max(seq) top, coalesce(bool_or(filled>100),false) AND count(*) FILTER (WHERE seq=1)>0 over_fill FROM b GROUP BY 1) SELECT intent_id, n1>1 OR over_fill corrupt, CASE WHEN n1=0 AND top>1 THEN CAST(1 AS BIGINT) END missing_seq, CASE WHEN n1>1 THEN 'repeated sequence' WHEN over_fill THEN 'fill beyond the quantity' END reason FROM s"
)
def t5_order_corruption(spark, sf_dir):
    """Repeated and missing sequences and impossible fills, over a restart: which intents are corrupt, why, and what the others wait for."""
    out = _orders_in_two_runs(spark, sf_dir, "intent_id", "status", "missing_seq", "reason", events=_BROKEN)
    return out.select("intent_id", (F.col("status") == "CORRUPT").alias("corrupt"), "missing_seq", "reason")


@query("SELECT event_id, user_id FROM events")
def t6_stream_dedupe(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return drained(spark, X.deduplicated(replay(spark, e.unionByName(e.where("event_id%3=0"))), ["event_id"], "60 days").select("event_id", "user_id"))


@query(TICKS + ", m AS (SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) minute_start, symbol, CAST(sum(volume) AS BIGINT) bar_volume FROM ticks GROUP BY 1,2) SELECT minute_start, symbol, bar_volume, CASE WHEN symbol='000030' THEN bar_volume-1 ELSE bar_volume END tick_volume FROM m WHERE minute(minute_start)%7<>0")
def t7_reconcile_streams(spark, sf_dir):
    m = ticks(spark, sf_dir).groupBy(F.date_trunc("minute", "ts").alias("minute_start"), "symbol").agg(F.sum("volume").alias("bar_volume"))
    other = m.where("minute(minute_start)%7<>0").select(F.col("minute_start").alias("tick_start"), F.col("symbol").alias("tick_symbol"), F.when(F.col("symbol") == "000030", F.col("bar_volume") - 1).otherwise(F.col("bar_volume")).alias("tick_volume"))
    out = drained(spark, X.reconcile_streams(replay(spark, m), replay(spark, other)))
    return out.withColumn("minute_start", F.col("minute_start").cast("timestamp_ntz"))


@query(BARS + " SELECT snapshot_date, symbol, CAST(sum(volume) AS BIGINT) volume FROM bars_1m WHERE minute<920 GROUP BY 1,2")
def t8_upsert_sink(spark, sf_dir):
    b = fixtures.bars_1m(spark, sf_dir).where(B.minute_of(F.col("ts_hms")) < 920)
    stream = replay(spark, b).groupBy("snapshot_date", "symbol").agg(F.sum("volume").alias("volume"))
    return X.drain_updates(stream, scratch(spark, "upsert"), ["snapshot_date", "symbol"], scratch(spark, "progress"))
