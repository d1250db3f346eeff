"""Market tables derived from the given ones, in SQL that both Spark and DuckDB run.

Every table is a WITH query; `spark_frame` gives it as a DataFrame, `sql` as
text to put before an oracle's SELECT.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.sources.stores import shared_path, shuffles_removed

# symbol = supplier, date = ship date + 24 years
PRICE_HISTORY = """
WITH li AS (
  SELECT l.l_suppkey AS k, CAST(l.l_shipdate AS DATE) AS d0, l.l_orderkey ok, l.l_linenumber ln, l.l_partkey pk, l.l_extendedprice ep, l.l_quantity q,
         900.0e0 * (1 + l.l_suppkey % 89) AS base, l.l_tax tax, l.l_discount disc, l.l_returnflag rf, l.l_linestatus ls
  FROM {lineitem} l),
px AS (SELECT *, CAST(floor(base*(1+(tax-0.04e0))+0.5e0) AS DOUBLE) AS o, CAST(floor(base*(1+3*(disc-0.05e0))+0.5e0) AS DOUBLE) AS c FROM li),
hl AS (SELECT *, greatest(o,c)+ (CAST(q AS INT)%5)*10 AS h, least(o,c)-(CAST(q AS INT)%3)*10 AS lo,
   row_number() OVER (PARTITION BY k,d0 ORDER BY ok,ln,pk,ep,q,tax,disc) rn, count(*) OVER (PARTITION BY k,d0) n FROM px),
day AS (SELECT k,d0, max(CASE WHEN rn=1 THEN o END) AS open, max(h) AS high, min(lo) AS low, max(CASE WHEN rn=n THEN c END) AS close,
   sum(q) AS volume, sum(q*c)/1e6 AS trade_value_100m,
   sum(CASE WHEN rf='R' THEN q WHEN rf='A' THEN -q ELSE 0 END) AS inst_netbuy,
   sum(CASE WHEN ls='F' THEN q ELSE -q END) AS foreign_netbuy, max(base) base FROM hl GROUP BY k,d0)
SELECT {plus24} AS date, lpad(CAST(k AS {text}),6,'0') AS symbol,
  CASE WHEN s.s_nationkey%2=0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, open,high,low,close, close AS close_raw,
  lag(close) OVER (PARTITION BY k ORDER BY d0) AS prev_close, volume, trade_value_100m,
  CASE WHEN day(d0)%11=0 THEN NULL ELSE base*(500+k%700)/100.0e0 END AS market_cap_100m, inst_netbuy, foreign_netbuy,
  inst_netbuy - foreign_netbuy AS program_netbuy
FROM day JOIN {supplier} s ON s.s_suppkey=day.k
"""

# symbol = event type, session minutes 09:00 .. 15:30
_TICK_CTE = """
WITH e AS (
 SELECT event_id, CAST(ts AS DATE) AS snapshot_date, event_type,
   CASE event_type WHEN 'click' THEN '000010' WHEN 'view' THEN '000020' WHEN 'purchase' THEN '000030' WHEN 'signup' THEN '000040' ELSE '000050' END AS symbol,
   540 + CAST(floor((hour(ts)*60+minute(ts))*391/1440.0e0) AS INT) AS m, ts, CAST(floor(10000 + value*10) AS DOUBLE) AS price, {jk} AS volume
 FROM {events})
"""
TICKS = (
    _TICK_CTE
    + """
SELECT event_id, snapshot_date, symbol, CAST(floor(m/60) AS INT)*10000+(m%60)*100+CAST(second(ts) AS INT) AS ts_hms, m AS minute, price, volume, ts,
  CASE WHEN event_id%7=0 THEN 'toss' ELSE 'kis' END AS vendor FROM e
"""
)
BARS = (
    _TICK_CTE
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY symbol,snapshot_date,m ORDER BY ts,event_id) rn, count(*) OVER (PARTITION BY symbol,snapshot_date,m) n FROM e)
SELECT snapshot_date, symbol, CAST(floor(m/60) AS INT)*10000+(m%60)*100 AS ts_hms, m AS minute, max(CASE WHEN rn=1 THEN price END) AS open, max(price) AS high, min(price) AS low,
  max(CASE WHEN rn=n THEN price END) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(price*volume) AS DOUBLE) AS value_krw, sum(volume)>0 AS has_trade, 'kis' AS vendor
FROM r GROUP BY snapshot_date,symbol,m
"""
)
TABLES = {"price_history": PRICE_HISTORY, "ticks": TICKS, "bars_1m": BARS}

_SPARK = {"plus24": "CAST(add_months(d0, 288) AS DATE)", "text": "STRING", "jk": "CAST(get_json_object(props,'$.k') AS BIGINT)"}
_DUCK = {"plus24": "CAST(d0 + INTERVAL 288 MONTH AS DATE)", "text": "VARCHAR", "jk": "CAST(json_extract_string(props,'$.k') AS BIGINT)"}
_BASE = ("lineitem", "supplier", "events")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name]
    used = {n: base(spark, sf_dir, n) for n in _BASE if "{" + n + "}" in text}
    if "lineitem" in used:
        used["lineitem"] = used["lineitem"].repartition("l_suppkey")  # serves every window and group of the panel
    return spark.sql(text.format(**_SPARK, **{n: "{" + n + "}" for n in _BASE}), **used)


def sql(*names: str) -> str:
    """WITH ... that defines the named tables for an oracle; more CTEs may follow after a comma."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(**_DUCK, **{b: b for b in _BASE})})" for n in names)


#: Rows of line items for each bucket of the stored panel.
BUCKET_ROWS = 1_000_000
_stored: dict[tuple[str, str, str], str] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        at = f"{name}_{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            make(at)
        _stored[key] = at
    return _stored[key]


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel, derived once in a session and stored in buckets by symbol, so that windows and joins by symbol need no shuffle."""

    def make(at: str) -> None:
        buckets = max(spark.sparkContext.defaultParallelism, -(-base(spark, sf_dir, "lineitem").count() // BUCKET_ROWS))
        derived = spark_frame(spark, sf_dir, "price_history").repartition(buckets, "symbol").sortWithinPartitions("symbol", "date")
        derived.write.option("path", shared_path(spark, "panel")).bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(at)

    return spark.table(_kept(spark, sf_dir, "price_history", make))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_frame(spark, sf_dir, "ticks")


def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-minute bars, derived once in a session and stored."""

    def make(at: str) -> None:
        spark_frame(spark, sf_dir, "bars_1m").write.option("path", shared_path(spark, "bars")).saveAsTable(at)

    return spark.table(_kept(spark, sf_dir, "bars_1m", make))
