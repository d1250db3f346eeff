"""Queries of stores, ledgers and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import calendar as C
from tapewright.operators import ledgers as G
from tapewright.operators import normalize as N
from tapewright.plans import fixtures
from tapewright.plans.bar_queries import bars
from tapewright.plans.oracle import BARS, PREP, TICKS, query, r, rounded, tax
from tapewright.plans.panel_queries import calendar, prepared
from tapewright.plans.selection_queries import POOL, picked, pooled
from tapewright.sources import stores as S

scratch = S.shared_path


def stored_bars(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "bars")
    S.write_bars(bars(spark, sf_dir).withColumn("session", F.when(F.col("minute") % 2 == 0, "regular").otherwise("evening")), path)
    return path


@query(BARS + " SELECT symbol, ts_hms, close FROM bars_1m WHERE minute%2=0 AND snapshot_date = DATE '2024-01-12' AND ts_hms BETWEEN 90500 AND 151959")
def s1_pruned_scan(spark, sf_dir):
    return S.scan_bars(spark, stored_bars(spark, sf_dir), "regular", "2024-01-12", ["symbol", "ts_hms", "close"], 90500, 151959)


@query(BARS + " SELECT symbol, ts_hms, close FROM bars_1m WHERE minute%2=1 AND snapshot_date = DATE '2024-01-12' AND ts_hms BETWEEN 90500 AND 151959")
def s2_second_session_scan(spark, sf_dir):
    return S.scan_bars(spark, stored_bars(spark, sf_dir), "evening", "2024-01-12", ["symbol", "ts_hms", "close"], 90500, 151959)


@query(BARS + " SELECT CASE WHEN minute%2=0 THEN 'regular' ELSE 'evening' END AS session, snapshot_date, count(*) n FROM bars_1m GROUP BY 1,2")
def s3_partition_layout(spark, sf_dir):
    return spark.read.parquet(stored_bars(spark, sf_dir)).groupBy("session", "snapshot_date").agg(F.count("*").alias("n"))


@query(PREP + " SELECT date, symbol, close FROM price_history WHERE date > (SELECT max(date) FROM price_history) - 200")
def s4_lookback(spark, sf_dir):
    return S.lookback(fixtures.price_history(spark, sf_dir), ["symbol", "close"])


_NEWBARS = ", nb AS (SELECT snapshot_date, symbol, ts_hms, close+1 AS close FROM bars_1m WHERE symbol IN ('000010','000030') AND minute%3=0), ob AS (SELECT snapshot_date, symbol, ts_hms, close FROM bars_1m)"


def old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf_dir)
    cols = ["snapshot_date", "symbol", "ts_hms", "close"]
    return b.select(*cols), b.where("symbol IN ('000010','000030') AND minute%3=0").withColumn("close", F.col("close") + 1).select(*cols)


@query(BARS + _NEWBARS + " SELECT * FROM nb UNION ALL SELECT * FROM ob WHERE (snapshot_date, symbol) NOT IN (SELECT snapshot_date, symbol FROM nb)")
def s5_replace_symbols(spark, sf_dir):
    return S.replace_symbols(*old_new(spark, sf_dir))


@query(TICKS + " SELECT symbol, count(*) n, CAST(sum(volume) AS BIGINT) volume FROM (SELECT symbol, volume FROM ticks WHERE symbol='000020' AND minute%2=0 UNION ALL SELECT symbol, volume FROM ticks WHERE symbol<>'000020') GROUP BY 1")
def s6_replace_ticks(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    return S.replace_symbols(t, t.where("symbol='000020' AND minute%2=0")).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query(BARS + _NEWBARS + ", a AS (SELECT snapshot_date, symbol, count(*) n_old FROM ob GROUP BY 1,2), b AS (SELECT snapshot_date, symbol, count(*) n_new FROM nb GROUP BY 1,2) SELECT b.snapshot_date, b.symbol, n_old, n_new FROM a JOIN b ON a.snapshot_date=b.snapshot_date AND a.symbol=b.symbol WHERE n_new<n_old AND day(b.snapshot_date)%2=1")
def s7_shrink_guard(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    _, refused = S.shrink_guard(old, new, old.where("day(snapshot_date)%2=0"))
    return refused.select("snapshot_date", "symbol", "n_old", "n_new").distinct()


@query(BARS + " SELECT symbol, count(*) n FROM bars_1m WHERE symbol<>'000040' GROUP BY 1")
def s8_remove_symbols(spark, sf_dir):
    b = bars(spark, sf_dir)
    return S.remove_symbols(b, b.where("symbol='000040'")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id%2 DESC, event_id DESC)=1")
def s9_upsert_last_wins(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return S.upsert_last_wins(e.where("event_id%2=0"), e.where("event_id%2=1"), ["user_id", "event_type"], "event_id")


@query(PREP + " SELECT date, count(*) n, sum(close) close_sum FROM (SELECT date, close FROM price_history WHERE NOT (day(date)=3) UNION ALL SELECT date, close*2 FROM price_history WHERE day(date)=3) GROUP BY date")
def s10_replace_dates(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).select("date", "symbol", "close")
    return S.replace_dates(p, p.where("day(date)=3").withColumn("close", F.col("close") * 2)).groupBy("date").agg(F.count("*").alias("n"), F.sum("close").alias("close_sum"))


@query(PREP + ", st AS (SELECT symbol, max(date) l FROM price_history WHERE date < DATE '2025-01-01' AND CAST(symbol AS INT)%5<>0 GROUP BY 1) SELECT p.date, p.symbol FROM price_history p LEFT JOIN st ON st.symbol=p.symbol WHERE l IS NULL OR p.date > l")
def s11_append_newer(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).select("date", "symbol")
    return S.append_newer(p.where("date < date'2025-01-01' AND CAST(symbol AS INT)%5<>0"), p)


@query(PREP + " SELECT date FROM cal WHERE date > DATE '2025-03-01' AND date <= DATE '2025-06-01' AND date > (SELECT max(date) FROM price_history WHERE date <= DATE '2025-03-01')")
def s12_new_dates(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return S.new_dates(C.sessions(p), p.where("date <= date'2025-03-01'"), "2025-06-01")


def envelope_path(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "raw")
    e = fixtures.base(spark, sf_dir, "events")
    e.select(F.col("event_type").alias("run_id"), (F.col("event_id") % 3).cast("int").alias("attempt_index"), F.to_json(F.struct("event_id", "value", "user_id")).alias("payload")).write.json(path)
    return path


@query(f"SELECT event_type AS run_id, CAST(event_id%3 AS INT) attempt_index, count(*) n, {r('sum(value)', 3)} AS value FROM events GROUP BY 1,2")
def s13_envelopes(spark, sf_dir):
    e = S.envelopes(spark, envelope_path(spark, sf_dir))
    return e.groupBy("run_id", "attempt_index").agg(F.count("*").alias("n"), F.round(F.sum(F.get_json_object("payload", "$.value").cast("double")), 3).alias("value"))


@query("SELECT event_type AS kind, count(*) n, max(event_id) AS last FROM events WHERE event_id%7<>0 GROUP BY 1")
def s14_ledger_lines(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("id")))
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return S.ledger_lines(lines, "kind string, id long").groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(PREP + " SELECT count(*) n_rows, CAST(0 AS BIGINT) n_differ FROM price_history WHERE day(date)<>9")
def s15_base_and_patch(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).select("date", "symbol", "close", "volume")
    now = p.where("day(date)<>9").withColumn("close", F.when(F.dayofmonth("date") == 4, F.col("close") + 1).otherwise(F.col("close")))
    base = p.where("day(date)<>5")
    changed, deleted = S.make_patch(base, now, ["date", "symbol"])
    built = S.apply_patch(base, changed, deleted, ["date", "symbol"])
    differ = built.exceptAll(now).unionByName(now.exceptAll(built)).agg(F.count("*").alias("n_differ"))
    return built.agg(F.count("*").alias("n_rows")).crossJoin(differ)


@query(PREP + " SELECT CAST(v AS INT) AS version, CAST(year(date)*100+month(date) AS INT) AS month, count(*) n_rows, CAST(sum(volume) AS BIGINT) volume FROM price_history, range(1,4) t(v) WHERE day(date)<>9+v GROUP BY 1,2")
def s15_monthly_rebuild(spark, sf_dir):
    """Three patches on one base by month, each rebuilt and proven equal to its source; then rows and volume by month."""
    p = fixtures.price_history(spark, sf_dir).select("date", "symbol", "close", F.col("volume").cast("long").alias("volume"))
    top, out = scratch(spark, "offsite"), None
    S.write_base(p.where("day(date)<>5"), top, ["symbol", "date"])
    for v in (1, 2, 3):
        now = p.where(F.dayofmonth("date") != 9 + v).withColumn("close", F.when(F.dayofmonth("date") == v, F.col("close") + 1).otherwise(F.col("close")))
        S.write_patch(now, top, ["symbol", "date"], v)
        built = S.rebuilt(spark, top, ["symbol", "date"], now.schema, v).groupBy(F.lit(v).alias("version"), (F.year("date") * 100 + F.month("date")).alias("month")).agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume"))
        out = built if out is None else out.unionByName(built)
    return out


@query("SELECT event_type, count(*) n, max(floor(value)) ask1, min(floor(value)-1) bid1 FROM events GROUP BY 1")
def s16_ladder_rows(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    raw = e.select("event_type", F.to_json(F.create_map(F.lit("askp1"), F.floor("value").cast("string"), F.lit("bidp1"), (F.floor("value") - 1).cast("string"))).alias("payload"))
    return S.ladder_rows(raw).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ask1").alias("ask1"), F.min("bid1").alias("bid1"))


@query(PREP + " SELECT CAST(year(date) AS INT) AS year, count(*) n, max(date) last_date FROM price_history GROUP BY 1")
def s17_dataset_partition(spark, sf_dir):
    path = scratch(spark, "dataset")
    S.write_dataset(fixtures.price_history(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(PREP + " SELECT date, symbol, CAST(close AS FLOAT)::DOUBLE AS close, CAST(volume AS BIGINT) volume FROM price_history")
def s18_downcast(spark, sf_dir):
    return S.downcast(fixtures.price_history(spark, sf_dir).select("date", "symbol", "close", "volume")).withColumn("close", F.col("close").cast("double"))


@query(PREP + " SELECT date, symbol, close, CAST(NULL AS VARCHAR) memo FROM price_history WHERE date=(SELECT max(date) FROM price_history)")
def s19_archive_snapshot(spark, sf_dir):
    return S.latest_archive(S.archive_rows(fixtures.price_history(spark, sf_dir), ["date", "symbol", "close", "memo"])).select("date", "symbol", "close", "memo")


@query(PREP + ", x AS (SELECT DISTINCT symbol, 'cohort' s FROM prep WHERE chg_ratio>0.2e0 UNION SELECT DISTINCT symbol, 'research' FROM prep WHERE chg_ratio<-0.2e0 UNION SELECT DISTINCT symbol, 'held' FROM prep WHERE is_ceiling) SELECT symbol, string_agg(s, '+' ORDER BY s) sources FROM x GROUP BY 1")
def s20_day_roster(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return S.day_roster(p.where("chg_ratio>0.2"), p.where("chg_ratio<-0.2"), p.where("is_ceiling"))


# Normalisation


@query(
    BARS
    + f""", cu AS (SELECT *, sum(value_krw) OVER (PARTITION BY snapshot_date, symbol ORDER BY minute) - CASE WHEN minute%29=0 THEN 1e9 ELSE 0 END cum FROM bars_1m), st AS (SELECT *, greatest(cum-coalesce(lag(cum) OVER (PARTITION BY snapshot_date, symbol ORDER BY minute),0),0) s FROM cu), f AS (SELECT *, CASE WHEN volume=0 THEN s=0 ELSE s BETWEEN low*volume AND high*volume END fits FROM st)
 SELECT snapshot_date, symbol, count(*) FILTER (WHERE fits) n_fits, {r('sum(CASE WHEN fits THEN s ELSE close*volume END)', 1)} value_krw FROM f GROUP BY 1,2"""
)
def n1_cumulative_to_value(spark, sf_dir):
    from pyspark.sql import Window as W

    b = bars(spark, sf_dir)
    w = W.partitionBy("snapshot_date", "symbol").orderBy("minute")
    b = b.withColumn("cum_value", F.sum("value_krw").over(w) - F.when(F.col("minute") % 29 == 0, 1e9).otherwise(0.0))
    return N.cumulative_to_value(b).groupBy("snapshot_date", "symbol").agg(F.count_if("from_cumulative").alias("n_fits"), F.round(F.sum("value_krw"), 1).alias("value_krw"))


def vendor_payloads(spark, sf_dir):
    """The bars as each vendor would send them: text, signs on prices, times in their own form; every 50th volume is no number."""
    b = bars(spark, sf_dir)
    t = lambda c: F.col(c).cast("string")
    hms = F.lpad(t("ts_hms"), 6, "0")
    volume = F.when(F.col("minute") % 50 == 7, "n/a").otherwise(t("volume"))
    minus = lambda c: F.concat(F.lit("-"), t(c))
    iso = F.concat(t("snapshot_date"), F.lit("T"), F.substring(hms, 1, 2), F.lit(":"), F.substring(hms, 3, 2), F.lit(":"), F.substring(hms, 5, 2), F.lit(".000+09:00"))
    prices = ("open", "high", "low", "close")
    renamed = lambda names: [t(c).alias(n) for c, n in zip(prices, names, strict=True)]
    key = ("snapshot_date", "symbol")
    return {
        "ls": b.select(*key, hms.alias("time"), *renamed(prices), volume.alias("jdiff_vol"), (F.col("value_krw") / 1e6).cast("string").alias("value")),
        "kiwoom": b.select(*key, F.concat(F.date_format("snapshot_date", "yyyyMMdd"), hms).alias("cntr_tm"), minus("open").alias("open_pric"), minus("high").alias("high_pric"), t("low").alias("low_pric"), minus("close").alias("cur_prc"), volume.alias("trde_qty")),
        "toss": b.select(*key, iso.alias("timestamp"), *renamed(("openPrice", "highPrice", "lowPrice", "closePrice")), volume.alias("volume")),
        "dbsec": b.select(*key, F.date_format("snapshot_date", "yyyyMMdd").alias("Date"), hms.alias("Hour"), *renamed(("Oprc", "Hprc", "Lprc", "Prpr")), volume.alias("CntgVol")),
    }


@query(
    BARS
    + f" SELECT v.vendor, snapshot_date, symbol, ts_hms, open, high, low, close, CASE WHEN minute%50<>7 THEN volume END volume, {r('CASE WHEN v.vendor=$$ls$$ THEN value_krw WHEN minute%50<>7 THEN close*volume END', 2)} value_krw, coalesce(minute%50<>7 AND volume>0,false) AS has_trade FROM bars_1m, (VALUES ('ls'),('kiwoom'),('toss'),('dbsec')) v(vendor)"
)
def n2_vendor_bars(spark, sf_dir):
    found = [N.vendor_bars(raw, vendor) for vendor, raw in vendor_payloads(spark, sf_dir).items()]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.withColumn("value_krw", F.round("value_krw", 2))


@query(BARS + " SELECT vendor, snapshot_date, symbol, ts_hms, open, high, low, close, CASE WHEN minute%31<>0 THEN volume END AS volume, value_krw, coalesce(minute%31<>0 AND volume>0,false) AS has_trade FROM bars_1m")
def n3_canonical_bars(spark, sf_dir):
    """Bars whose numbers came as text, symbols without leading zeros, some volumes no number."""
    b = bars(spark, sf_dir)
    raw = b.select("snapshot_date", F.col("symbol").cast("int").alias("symbol"), *(F.col(c).cast("string").alias(c) for c in ("ts_hms", "open", "high", "low", "close", "value_krw")), F.when(F.col("minute") % 31 == 0, "-").otherwise(F.col("volume").cast("string")).alias("volume"))
    return N.canonical_bars(raw, "kis")


@query(TICKS + " SELECT snapshot_date, symbol, count(*) n, count(*) >= 65 AS truncated, max(price) AS top FROM (SELECT snapshot_date, symbol, CAST(price AS INT) price FROM ticks) GROUP BY 1,2")
def n4_normalize_ticks(spark, sf_dir):
    t = N.normalize_ticks(fixtures.ticks(spark, sf_dir), 65)
    return t.groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("truncated"), F.max("price").alias("top"))


@query("SELECT event_type, count(*) n FROM events WHERE strftime(ts, '%Y%m%d') = '20240115' GROUP BY 1")
def n5_business_date(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    return N.business_date(e, "day", "20240115").groupBy("event_type").agg(F.count("*").alias("n"))


@query(PREP + f" SELECT date, symbol, market, open, close, prev_close AS base_price, volume, {r('trade_value_100m*1e6/1e8', 8)} trade_value_100m, false AS repeated FROM price_history WHERE prev_close IS NOT NULL")
def n6_exchange_block(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).where("prev_close is not null")
    t = lambda c: F.format_number(c, 0)
    raw = p.select(
        F.date_format("date", "yyyyMMdd").alias("BAS_DD"), F.col("symbol").cast("int").cast("string").alias("ISU_CD"), F.col("market").alias("MKT_NM"), t("open").alias("TDD_OPNPRC"), t("high").alias("TDD_HGPRC"), t("low").alias("TDD_LWPRC"), t("close").alias("TDD_CLSPRC"),
        t(F.col("close") - F.col("prev_close")).alias("CMPPREVDD_PRC"), t("volume").alias("ACC_TRDVOL"), (F.col("trade_value_100m") * 1e6).cast("string").alias("ACC_TRDVAL"), F.col("market_cap_100m").cast("string").alias("MKTCAP"),
    )
    return N.exchange_block(raw).select("date", "symbol", "market", "open", "close", "base_price", "volume", F.round("trade_value_100m", 8).alias("trade_value_100m"), "repeated")


@query(PREP + f" SELECT date, symbol, {r('inst_netbuy/1e6', 9)} inst_netbuy, {r('foreign_netbuy/1e6', 9)} foreign_netbuy FROM price_history")
def n7_flow_rows(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    one = F.struct(F.col("date").cast("string").alias("d"), F.col("symbol").alias("s"), F.col("inst_netbuy").alias("i"), F.col("foreign_netbuy").alias("f"), F.col("program_netbuy").alias("p"))
    payloads = p.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.to_json(F.collect_list(one)).alias("payload"))
    return N.flow_rows(payloads).select("date", "symbol", F.round("inst_netbuy", 9).alias("inst_netbuy"), F.round("foreign_netbuy", 9).alias("foreign_netbuy"))


@query(PREP + " SELECT a.date, a.symbol, b.x FROM price_history a LEFT JOIN (SELECT date, symbol, inst_netbuy AS x FROM price_history WHERE day(date)%5<>1) b ON a.date=b.date AND a.symbol=b.symbol")
def n8_join_flows(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return N.join_flows(p.select("date", "symbol"), p.where("day(date)%5<>1").select("date", "symbol", F.col("inst_netbuy").alias("x")))


@query("SELECT lpad(CAST(user_id AS VARCHAR),6,'0') symbol, event_type, event_id, value FROM events WHERE user_id%2=0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC)=1")
def n9_alt_panel(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), "event_type", "event_id", "value")
    return N.alt_panel(e, e.where("CAST(symbol AS INT)%2=0"), ["symbol", "event_type"], ["event_id"])


@query("SELECT DATE '2024-01-02' AS date, lpad(CAST(s_suppkey AS VARCHAR),6,'0') symbol, s_suppkey%3<>0 AND s_nationkey%2=0 AND NOT s_acctbal<0 AS is_screenable FROM supplier")
def n10_classification(spark, sf_dir):
    s = fixtures.base(spark, sf_dir, "supplier")
    raw = s.select(F.lit("2024-01-02").cast("date").alias("date"), F.col("s_suppkey").cast("string").alias("code"), F.when(F.col("s_suppkey") % 3 != 0, "common").otherwise("preferred").alias("kind"), F.when(F.col("s_nationkey") % 2 == 0, "KOSPI").otherwise("KONEX").alias("board"), (F.col("s_acctbal") < 0).alias("halted"), F.lit(None).cast("boolean").alias("administrative"))
    return N.classification(raw).select("date", "symbol", "is_screenable")


@query("SELECT CAST(user_id AS VARCHAR) symbol, arg_min(value,(CAST(event_id//3 AS INT), CAST(event_id%3 AS INT))) AS value, min((CAST(event_id//3 AS INT), CAST(event_id%3 AS INT)))[1] AS page FROM events GROUP BY user_id HAVING count(DISTINCT (event_id//3, event_id%3)) = count(*)")
def n11_earliest_of_pages(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    e = e.join(e.groupBy("user_id").agg(F.count_distinct(F.floor(F.col("event_id") / 3), F.col("event_id") % 3).alias("a"), F.count("*").alias("b")).where("a = b"), "user_id")
    pages = e.groupBy(F.floor(F.col("event_id") / 3).cast("int").alias("page"), (F.col("event_id") % 3).cast("int").alias("attempt")).agg(F.to_json(F.collect_list(F.struct(F.col("user_id").cast("string").alias("symbol"), "value"))).alias("payload"))
    return N.earliest_of_pages(pages, "symbol:string,value:double").select("symbol", "value", "page")


@query("SELECT CAST(user_id AS VARCHAR) symbol, CAST(max(event_id%3) AS INT) attempt, arg_max(value,(event_id%3,event_id)) AS value FROM events GROUP BY user_id")
def n12_last_attempt(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.col("event_id").alias("seq"), "value")
    return N.last_attempt(e, ["value"])


@query("WITH e AS (SELECT user_id, event_id%3 a, CAST(hour(ts) AS INT) h, value FROM events), m AS (SELECT user_id, max(a) a FROM e GROUP BY 1) SELECT CAST(e.user_id AS VARCHAR) symbol, h AS hour, max(value) AS value FROM e JOIN m ON m.user_id=e.user_id AND m.a=e.a GROUP BY 1,2")
def n13_nested_series(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    payloads = e.groupBy(F.col("user_id").cast("string").alias("symbol"), (F.col("event_id") % 3).alias("attempt")).agg(F.to_json(F.collect_list(F.struct(F.hour("ts").alias("h"), F.col("value").alias("v")))).alias("payload"))
    return N.nested_series(payloads)


@query(TICKS + " SELECT snapshot_date, symbol, CASE WHEN ts_hms>=153000 THEN 'AUCTION_FILL' WHEN volume>0 THEN 'UNEXPECTED_TRADE' ELSE 'INDICATIVE' END AS kind, row_number() OVER (PARTITION BY snapshot_date, symbol ORDER BY ts_hms, event_id) seq, event_id FROM ticks WHERE ts_hms>=150000")
def n15_auction_path(spark, sf_dir):
    return N.auction_path(fixtures.ticks(spark, sf_dir), 150000).select("snapshot_date", "symbol", "kind", "seq", "event_id")


_CUM = "SELECT snapshot_date, symbol, ts_hms, price AS strength, sum(volume) OVER (PARTITION BY snapshot_date, symbol ORDER BY ts, event_id) AS cum_volume FROM {t}"


@query(TICKS + f", c AS ({_CUM.format(t='ticks')}) SELECT snapshot_date, symbol, arg_max(strength,(cum_volume,ts_hms)) FILTER (WHERE ts_hms<152000) strength_1520, arg_max(strength,(cum_volume,ts_hms)) strength_eod FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY snapshot_date, symbol, cum_volume, ts_hms ORDER BY strength DESC)=1) GROUP BY 1,2")
def n16_strength_as_of(spark, sf_dir):
    c = spark.sql(_CUM, t=fixtures.ticks(spark, sf_dir))
    return N.strength_as_of(c.groupBy("snapshot_date", "symbol", "ts_hms", "cum_volume").agg(F.max("strength").alias("strength")))


_CATS = {"license": "[Ll]icen[cs]", "contact": "@|555-", "shout": "!!"}


@query("SELECT source, lang, count(*) FILTER (WHERE regexp_matches(text,'[Ll]icen[cs]')) n_license, count(*) FILTER (WHERE regexp_matches(text,'@|555-')) n_contact, count(*) FILTER (WHERE regexp_matches(text,'!!')) n_shout, bool_or(coalesce(regexp_matches(text,'[Ll]icen[cs]'),false)) material FROM documents GROUP BY 1,2")
def n17_category_counts(spark, sf_dir):
    d = fixtures.base(spark, sf_dir, "documents").withColumnRenamed("text", "title")
    return N.category_counts(d, _CATS, ["license"], ["source", "lang"])


@query(
    PREP
    + ", k AS (SELECT date, close AS settle, open AS spot, 'K200 '||CASE WHEN CAST(symbol AS INT)%7=0 THEN 'SP ' ELSE '' END||'F '||CAST(CAST((year(date)-1+CAST(symbol AS INT)%3)*100+1+CAST(symbol AS INT)%12 AS INT) AS VARCHAR) AS name, symbol FROM price_history), e AS (SELECT *, CAST(right(name,6) AS INT) expiry FROM k WHERE name NOT LIKE '%SP%'), u AS (SELECT date, expiry, min(symbol) s FROM e GROUP BY 1,2) SELECT e.date, e.expiry, settle-spot AS basis FROM e JOIN u ON u.date=e.date AND u.expiry=e.expiry AND u.s=e.symbol QUALIFY row_number() OVER (PARTITION BY e.date ORDER BY e.expiry < CAST(strftime(e.date,'%Y%m') AS INT), e.expiry)=1"
)
def n18_front_month(spark, sf_dir):
    s = F.col("symbol").cast("int")
    p = fixtures.price_history(spark, sf_dir)
    name = F.concat(F.lit("K200 "), F.when(s % 7 == 0, "SP ").otherwise(""), F.lit("F "), ((F.year("date") - 1 + s % 3) * 100 + 1 + s % 12).cast("string"))
    k = p.select("date", F.col("close").alias("settle"), F.col("open").alias("spot"), F.lit("K200").alias("product"), name.alias("name"), "symbol")
    one = k.groupBy("date", "name", "product").agg(F.min(F.struct("symbol", "settle", "spot")).alias("m")).select("date", "name", "product", "m.settle", "m.spot")
    return N.front_month(one, "K200").select("date", "expiry", "basis")


@query(
    PREP
    + ", a AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY tv_clean DESC, symbol) pl FROM prep QUALIFY pl<=5), b AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) pl FROM prep QUALIFY pl<=5), x AS (SELECT *, 0 t FROM a UNION ALL SELECT *, 1 FROM b) SELECT date, symbol, CAST(min((t,pl))[1] AS INT) turn, CAST(min((t,pl))[2] AS INT) place, count(*) n_lists FROM x GROUP BY 1,2"
)
def n19_candidate_union(spark, sf_dir):
    from tapewright.operators.universe import top_k

    p = prepared(spark, sf_dir)
    lists = [top_k(p, 5, [F.col(c).desc()]).select("date", "symbol", F.col("rank").cast("int").alias("place")) for c in ("tv_clean", "volume")]
    return N.candidate_union(lists)


@query("SELECT event_id AS place, CASE WHEN event_id%13=0 THEN 'bad_code' WHEN row_number() OVER (PARTITION BY CASE WHEN event_id%13=0 THEN 'x' ELSE lpad(CAST(user_id AS VARCHAR),6,'0') END ORDER BY event_id)>1 THEN 'repeated' WHEN event_id%5=0 THEN 'no_name' END AS reason FROM events")
def n20_roster_rows(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").alias("place"), F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("symbol"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("name"))
    good, bad = N.roster_rows(raw)
    return good.select("place", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("place", "reason"))


@query(PREP + f" SELECT date, symbol, close, {r('chg_ratio')} chg_ratio FROM prep")
def n21_snapshot_round_trip(spark, sf_dir):
    p = prepared(spark, sf_dir).select("date", "symbol", "close", "chg_ratio", "trade_value_100m")
    return rounded(N.snapshot_to_panel(N.panel_to_snapshot(p)).select("date", "symbol", "close", "chg_ratio"))


@query(PREP + f" SELECT date, symbol, {r('round(chg_ratio*100,2)')} ret_pct, close FROM prep WHERE chg_ratio IS NOT NULL")
def n22_clean_journal(spark, sf_dir):
    p = prepared(spark, sf_dir).where("chg_ratio is not null")
    raw = p.select("date", "symbol", F.concat(F.round(F.col("chg_ratio") * 100, 2).cast("string"), F.lit(" %")).alias("(수익률, %)"), F.format_number("close", 1).alias("(종가)"))
    return rounded(N.clean_journal(raw, {"(수익률, %)": "ret_pct", "(종가)": "close"}, ["ret_pct", "close"]))


@query("SELECT event_id, 'api_key=*** user='||user_id||' Authorization: Bearer ***' AS masked FROM events")
def n23_mask_secrets(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    text = F.concat(F.lit("api_key=k"), F.col("event_id"), F.lit(" user="), F.col("user_id"), F.lit(" Authorization: Bearer abcdefgh"), F.col("event_id"))
    return e.select("event_id", N.mask_secrets(text).alias("masked"))


# Ledgers

_JOURNAL = """SELECT o_orderkey AS intent_id, k AS seq, CASE k WHEN 0 THEN 'INTENT' WHEN 1 THEN 'SEND' WHEN 2 THEN 'RESULT' ELSE 'BROKER_STATE' END AS kind,
 CASE WHEN k=2 THEN CASE WHEN o_orderkey%11=0 THEN 'rejected' WHEN o_orderkey%13=0 THEN 'throttled' ELSE 'accepted' END WHEN k=3 THEN CASE WHEN o_orderkey%17=0 THEN 'cancelled' ELSE 'final' END END AS outcome,
 CAST(100 AS BIGINT) AS qty, CASE WHEN k=3 THEN CAST(CASE WHEN o_orderkey%17=0 THEN 0 WHEN o_orderkey%5=0 THEN 40 ELSE 100 END AS BIGINT) END AS filled
 FROM {orders} JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t ON k <= CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END"""


@query(
    f"WITH j AS ({_JOURNAL.format(orders='orders')}), g AS (SELECT intent_id, count(*) FILTER (WHERE kind='SEND') n_sends, max(CASE WHEN kind='BROKER_STATE' THEN outcome END) fin, coalesce(max(filled),0) filled, max(CASE WHEN kind='RESULT' THEN outcome END) res FROM j GROUP BY 1) SELECT intent_id, CASE WHEN fin IS NOT NULL THEN CASE WHEN filled>=100 THEN 'FILLED' WHEN filled>0 THEN 'PARTIAL' WHEN fin='cancelled' THEN 'CANCELLED' ELSE 'UNFILLED' END WHEN res='accepted' THEN 'ACKED' WHEN res='rejected' THEN 'REJECTED' WHEN res IS NULL THEN 'UNKNOWN' ELSE 'NOT_SENT' END status, filled, n_sends, false repeated_seq FROM g"
)
def g1_order_state(spark, sf_dir):
    o = fixtures.base(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    return G.order_state(spark.sql(_JOURNAL, orders=o))


_FILLS = POOL + """, buys AS (SELECT CAST(date AS VARCHAR)||':'||symbol AS order_id, symbol, close AS fill_price, date AS filled_on, next_date, next_open FROM picks), fills AS (SELECT order_id, CAST(NULL AS VARCHAR) entry_order_id, symbol, 'buy' AS side, CAST(10 AS BIGINT) qty, fill_price, filled_on FROM buys UNION ALL SELECT order_id||':x', order_id, symbol, 'sell', CASE WHEN day(filled_on)%4=0 THEN 6 ELSE 10 END, next_open, next_date FROM buys WHERE next_open IS NOT NULL)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = picked(spark, sf_dir).withColumn("order_id", F.concat_ws(":", F.col("date").cast("string"), "symbol"))
    buy = b.select("order_id", F.lit(None).cast("string").alias("entry_order_id"), "symbol", F.lit("buy").alias("side"), F.lit(10).cast("long").alias("qty"), F.col("close").alias("fill_price"), F.col("date").alias("filled_on"))
    sell = b.where("next_open is not null").select(F.concat("order_id", F.lit(":x")).alias("order_id"), F.col("order_id").alias("entry_order_id"), "symbol", F.lit("sell").alias("side"), F.when(F.dayofmonth("date") % 4 == 0, 6).otherwise(10).cast("long").alias("qty"), F.col("next_open").alias("fill_price"), F.col("next_date").alias("filled_on"))
    return buy.unionByName(sell)


@query(_FILLS + ", s AS (SELECT entry_order_id, sum(qty) q FROM fills WHERE side='sell' GROUP BY 1) SELECT order_id, symbol, filled_on AS since, CAST(qty-coalesce(q,0) AS BIGINT) open_qty FROM fills f LEFT JOIN s ON s.entry_order_id=f.order_id WHERE side='buy' AND qty-coalesce(q,0)>0")
def g2_open_lots(spark, sf_dir):
    return G.open_lots(fills(spark, sf_dir))


@query("WITH o AS (SELECT DISTINCT o_orderkey k, CAST(o_custkey%50 AS VARCHAR) s, CAST(floor(o_totalprice/20000) AS BIGINT) q FROM orders), i AS (SELECT k AS intent_id, s, q FROM o WHERE k%2=0), b AS (SELECT k AS broker_id, s, q FROM o WHERE k%2=1 AND k%3<>0 AND k%5<>0) SELECT intent_id, broker_id FROM i JOIN b ON i.s=b.s AND i.q=b.q")
def g3_broker_matches(spark, sf_dir):
    """Each side is dealt once before its copies go: intents by their terms, which serves the match, orders by id, which serves the ids that are out."""
    o = fixtures.base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).cast("string").alias("symbol"), F.floor(F.col("o_totalprice") / 20000).alias("qty"), F.lit("buy").alias("side"), F.lit(1.0).alias("limit_price"))
    orders = o.where("k%2=1").withColumnRenamed("k", "broker_id")
    intents = o.where("k%2=0").withColumnRenamed("k", "intent_id").repartition("symbol", "qty").distinct()
    return G.broker_matches(intents, orders.repartition("broker_id").distinct(), orders.where("broker_id%3=0"), orders.where("broker_id%5=0"))


@query("WITH o AS (SELECT DISTINCT o_orderkey k FROM orders), a AS (SELECT k, 10 q FROM o WHERE k%7<>0), b AS (SELECT k, CASE WHEN k%5=0 THEN 9 ELSE 10 END q FROM o WHERE k%11<>0) SELECT CASE WHEN b.q IS NULL THEN 'missing_at_broker' WHEN a.q IS NULL THEN 'unknown_order' WHEN a.q<>b.q THEN 'quantity' ELSE 'matched' END AS class, count(*) n FROM a FULL JOIN b ON a.k=b.k GROUP BY 1")
def g4_reconcile(spark, sf_dir):
    o = fixtures.base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("intent_id")).distinct()
    return G.reconcile(o.where("intent_id%7<>0").withColumn("qty", F.lit(10)), o.where("intent_id%11<>0").withColumn("qty", F.when(F.col("intent_id") % 5 == 0, 9).otherwise(10)))


@query(
    _FILLS
    + f", t AS (SELECT s.order_id, s.qty, s.fill_price*s.qty no, b.fill_price*s.qty co, CAST(s.filled_on-b.filled_on AS INT) carry_days, floor(s.fill_price*s.qty*({tax('s.filled_on')})/1e4) tx FROM fills s JOIN fills b ON b.order_id=s.entry_order_id AND b.side='buy' WHERE s.side='sell') SELECT order_id, carry_days, CAST(tx AS BIGINT) tax, {r('no-co-tx-(no+co)*0.72792e0/2/1e4', 4)} net_pnl, {r('(no-co-tx-(no+co)*0.72792e0/2/1e4)/co')} net_ret FROM t"
)
def g5_round_trips(spark, sf_dir):
    out = G.round_trips(fills(spark, sf_dir))
    return out.select("order_id", "carry_days", "tax", F.round("net_pnl", 4).alias("net_pnl"), F.round("net_ret", 6).alias("net_ret"))


@query(
    _FILLS
    + f", ol AS (SELECT f.symbol, qty-coalesce(q,0) oq, fill_price FROM fills f LEFT JOIN (SELECT entry_order_id, sum(qty) q FROM fills WHERE side='sell' GROUP BY 1) s ON s.entry_order_id=f.order_id WHERE side='buy' AND qty-coalesce(q,0)>0), mk AS (SELECT symbol, arg_max(close,date) mark FROM price_history WHERE CAST(symbol AS INT)%9<>0 GROUP BY 1), h AS (SELECT sum(oq*fill_price) cost_basis, sum(oq*coalesce(mark,fill_price)) market_value, count(*) FILTER (WHERE mark IS NULL) n_unmarked FROM ol LEFT JOIN mk ON mk.symbol=ol.symbol) SELECT {r('(SELECT 1e9-sum(CASE WHEN side=' + chr(39) + 'buy' + chr(39) + ' THEN qty*fill_price ELSE -qty*fill_price END) FROM fills)', 1)} AS cash, {r('cost_basis', 1)} cost_basis, {r('market_value', 1)} market_value, n_unmarked FROM h"
)
def g6_nav_snapshot(spark, sf_dir):
    marks = fixtures.price_history(spark, sf_dir).where("CAST(symbol AS INT)%9<>0").groupBy("symbol").agg(F.max_by("close", "date").alias("mark"))
    return rounded(G.nav_snapshot(fills(spark, sf_dir), marks, 1e9).select("cash", "cost_basis", "market_value", "n_unmarked"), 1)


@query(_FILLS + " SELECT side, count(*) n FROM fills WHERE day(filled_on)<>10 GROUP BY 1")
def g7_effective_fills(spark, sf_dir):
    f = fills(spark, sf_dir)
    return G.effective_fills(f, f.where("day(filled_on)=10")).groupBy("side").agg(F.count("*").alias("n"))


@query(POOL + f" SELECT date, symbol, rank, CASE WHEN next_date IS NULL THEN 'PENDING' WHEN next_open IS NULL THEN 'NO_EXIT' ELSE 'REALIZED' END status, {r('gross')} gross FROM picks")
def g9_decision_returns(spark, sf_dir):
    return rounded(G.decision_returns(picked(spark, sf_dir)).select("date", "symbol", "rank", "status", "gross"))


@query(
    POOL
    + f""", pk AS (SELECT *, CASE WHEN next_date IS NULL THEN 'PENDING' WHEN next_open IS NULL THEN 'NO_EXIT' ELSE 'REALIZED' END st FROM picks), g AS (SELECT date, count(*) n, count(*) FILTER (WHERE st='REALIZED') nr, avg(net) k3, avg(CASE WHEN rank<=2 THEN net END) k2 FROM pk WHERE st<>'PENDING' GROUP BY 1 HAVING count(*)=3), a AS (SELECT date, CASE WHEN nr=3 THEN k3 END k3, CASE WHEN nr=3 THEN k2 END k2 FROM g),
 kn AS (SELECT date, avg(k3) OVER (ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) gm FROM a WHERE k3 IS NOT NULL), j AS (SELECT a.*, coalesce(gm, last_value(gm IGNORE NULLS) OVER (ORDER BY a.date ROWS UNBOUNDED PRECEDING)) gm FROM a LEFT JOIN kn ON kn.date=a.date) SELECT date, {r('k3')} k3, {r('k2')} k2, coalesce(gm>0,true) gate_open, {r('CASE WHEN coalesce(gm>0,true) THEN k3 WHEN k3 IS NOT NULL THEN 0e0 END')} gated FROM j"""
)
def g10_shadow_ledger(spark, sf_dir):
    return rounded(G.shadow_ledger(G.decision_returns(picked(spark, sf_dir)).drop("gross")).select("date", "k3", "k2", "gate_open", "gated"))


_LOG = "SELECT lpad(CAST(user_id%40 AS {text}),6,'0') AS symbol, CAST('2024-01-05' AS DATE) AS day, event_type AS session, CAST(ts AS DATE) AS run_day, CASE WHEN value>150 THEN 'DONE' WHEN value>60 THEN 'PARTIAL' ELSE 'FAILED' END AS status, event_id AS seq FROM {events}"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG.format(text="STRING", events="{events}"), events=fixtures.base(spark, sf_dir, "events"))


_LOGS = f"WITH log AS ({_LOG.format(text='VARCHAR', events='events')})"


@query(_LOGS + " SELECT symbol, session, arg_max(status,seq) status, count(*) n_records FROM log GROUP BY 1,2")
def g12_latest_status(spark, sf_dir):
    return G.latest_status(attempts(spark, sf_dir), ["symbol", "session"], ["seq"], ["status"])


@query(_LOGS + ", e AS (SELECT *, max(CASE WHEN status='DONE' THEN seq END) OVER (PARTITION BY symbol, day, session) x FROM log) SELECT symbol, day, session, count(DISTINCT CASE WHEN seq > coalesce(x,-1) AND run_day<>day THEN run_day END) attempts FROM e GROUP BY 1,2,3")
def g13_trailing_attempts(spark, sf_dir):
    return G.trailing_attempts(attempts(spark, sf_dir))


@query(_LOGS + ", l AS (SELECT symbol, session, arg_max(status,seq) status FROM log GROUP BY 1,2) SELECT session, status, count(*) n FROM l GROUP BY 1,2")
def g14_ledger_report(spark, sf_dir):
    return G.latest_status(attempts(spark, sf_dir), ["symbol", "session"], ["seq"], ["status"]).groupBy("session", "status").agg(F.count("*").alias("n"))


@query(_LOGS + ", l AS (SELECT symbol, session, arg_max(status,seq) status FROM log GROUP BY 1,2), p AS (SELECT lpad(CAST(x AS VARCHAR),6,'0') symbol, s.session FROM range(50) t(x), (SELECT DISTINCT session FROM log) s) SELECT p.session, count(*) n_planned, count(*) FILTER (WHERE status='DONE') n_resolved, count(*) FILTER (WHERE coalesce(status,'')<>'DONE') n_open FROM p LEFT JOIN l ON l.symbol=p.symbol AND l.session=p.session GROUP BY 1")
def g15_coverage_report(spark, sf_dir):
    log = attempts(spark, sf_dir)
    planned = spark.range(50).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("symbol")).crossJoin(log.select("session").distinct())
    return G.coverage_report(planned, G.latest_status(log, ["symbol", "session"], ["seq"], ["status"]), ["symbol", "session"])


@query(PREP + ", d AS (SELECT symbol, date AS day FROM price_history), k AS (SELECT d.*, CASE WHEN day(day)%2=0 THEN 'stored' WHEN DATE '2025-11-05'-day > 200 THEN 'beyond_retention' END skip FROM d) SELECT symbol, day, CASE WHEN skip IS NULL THEN CASE WHEN DATE '2025-11-05'-day <= 100 THEN 'near' ELSE 'far' END END vendor, skip FROM k".replace("WHEN day(day)%2", "WHEN day(d.day)%2"))
def g16_task_plan(spark, sf_dir):
    d = fixtures.price_history(spark, sf_dir).select("symbol", F.col("date").alias("day"))
    return G.task_plan(d, d.where("day(day)%2=0"), 200, "2025-11-05")


@query("WITH a AS (SELECT DISTINCT event_type AS class, CAST(ts AS DATE)-DATE '2024-01-01' AS seq FROM events), i AS (SELECT *, seq-row_number() OVER (PARTITION BY class ORDER BY seq) k FROM a) SELECT class, count(*) AS length, CAST(min(seq) AS BIGINT) AS first, CAST(max(seq) AS BIGINT) AS last FROM i GROUP BY class, k")
def g17_streaks(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("seq"))
    return G.streaks(e)


@query(
    "WITH due AS (SELECT DISTINCT event_type job, date_trunc('day',ts)+INTERVAL 9 HOUR due_at FROM events), sl AS (SELECT *, coalesce(lead(due_at) OVER (PARTITION BY job ORDER BY due_at), due_at+INTERVAL 1 DAY) u FROM due), rn AS (SELECT event_type job, ts began_at, CASE WHEN event_id%5=0 THEN 'error' ELSE 'ok' END outcome FROM events), f AS (SELECT s.job, s.due_at, min(began_at) b, arg_min(outcome,began_at) o FROM sl s JOIN rn ON rn.job=s.job AND began_at>=due_at AND began_at<u GROUP BY 1,2) SELECT s.job, s.due_at, CASE WHEN b IS NULL THEN 'MISSING' WHEN b>s.due_at+INTERVAL 10 MINUTE THEN 'LATE' WHEN o<>'ok' THEN 'FAILED' ELSE 'ON_TIME' END state FROM sl s LEFT JOIN f ON f.job=s.job AND f.due_at=s.due_at"
)
def g18_job_lateness(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events")
    due = e.select(F.col("event_type").alias("job"), (F.date_trunc("day", "ts") + F.expr("INTERVAL 9 HOUR")).cast("timestamp_ntz").alias("due_at")).distinct()
    runs = e.select(F.col("event_type").alias("job"), F.col("ts").alias("began_at"), F.when(F.col("event_id") % 5 == 0, "error").otherwise("ok").alias("outcome"))
    return G.job_lateness(due, runs).select("job", "due_at", "state")


@query(_LOGS + " SELECT status, session AS reason, count(*) n FROM log WHERE status<>'DONE' GROUP BY 1,2")
def g19_manifest_reasons(spark, sf_dir):
    log = attempts(spark, sf_dir).select(F.when(F.col("status") == "DONE", "COMPLETE").otherwise(F.col("status")).alias("status"), F.col("session").alias("reason"))
    return G.manifest_reasons(log)


@query(PREP + " SELECT c.date, bool_or(coalesce(is_ceiling,false)) ceiling, bool_or(coalesce(chg_ratio>0.1e0,false)) strong FROM cal c LEFT JOIN prep p ON p.date=c.date GROUP BY 1")
def g20_completeness_matrix(spark, sf_dir):
    p = prepared(spark, sf_dir)
    kinds = p.where("is_ceiling").select("date", F.lit("ceiling").alias("kind")).unionByName(p.where("chg_ratio > 0.1").select("date", F.lit("strong").alias("kind")))
    return G.completeness_matrix(calendar(spark, sf_dir), kinds, ["ceiling", "strong"])


@query("SELECT lpad(CAST(s.s_suppkey AS VARCHAR),6,'0') AS symbol, a.v, b.q FROM supplier s LEFT JOIN (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') k, max(value) v FROM events GROUP BY 1) a ON a.k=lpad(CAST(s.s_suppkey AS VARCHAR),6,'0') LEFT JOIN (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') k, count(*) q FROM events WHERE event_type='click' GROUP BY 1) b ON b.k=lpad(CAST(s.s_suppkey AS VARCHAR),6,'0')")
def n14_assemble_extras(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").withColumn("symbol", F.lpad(F.col("user_id").cast("string"), 6, "0"))
    cohort = fixtures.base(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"))
    return N.assemble_extras(cohort, e.groupBy("symbol").agg(F.max("value").alias("v")), e.where("event_type='click'").groupBy("symbol").agg(F.count("*").alias("q")))


@query(
    TICKS
    + ", o AS (SELECT event_id AS order_id, symbol, ts AS placed_at, CASE WHEN event_id%3=0 THEN 'market' ELSE 'limit' END AS rule, CASE WHEN event_id%2=0 THEN 'buy' ELSE 'sell' END side, price AS limit_price FROM ticks), j AS (SELECT order_id, min((t.ts, t.event_id, t.price)) p FROM o JOIN ticks t ON t.symbol=o.symbol AND t.ts>placed_at AND (rule='market' OR (side='buy' AND t.price<=limit_price) OR (side='sell' AND t.price>=limit_price)) GROUP BY 1) SELECT o.order_id, p[3] AS price, CASE WHEN p IS NULL THEN 'UNFILLED' ELSE 'FILLED' END status FROM o LEFT JOIN j ON j.order_id=o.order_id"
)
def g8_fill_decision(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    orders = t.select(F.col("event_id").alias("order_id"), "symbol", F.col("ts").alias("placed_at"), F.when(F.col("event_id") % 3 == 0, "market").otherwise("limit").alias("rule"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("price").alias("limit_price"))
    return G.fill_decision(orders, t.select("symbol", F.col("ts").alias("printed_at"), F.col("event_id").alias("print_id"), "price")).select("order_id", "price", "status")


@query(
    POOL
    + """, od AS (SELECT CAST(date AS VARCHAR)||':'||symbol AS order_id, date, symbol, CASE WHEN CAST(symbol AS INT)%2=0 THEN 'buy' ELSE 'sell' END AS side, close, next_open, next_date, CASE WHEN day(date)%7<>0 THEN day(date)%5<>0 END AS confirmed FROM pool)
 SELECT order_id, CASE WHEN side='buy' AND confirmed THEN close WHEN side='sell' AND next_open>0 THEN next_open END price, CASE WHEN side='buy' THEN 'auction_close' ELSE 'auction_open' END AS rule, CASE WHEN side='buy' AND coalesce(confirmed,false) OR side='sell' AND coalesce(next_open>0,false) THEN 'FILLED' ELSE 'UNFILLED' END status FROM od"""
)
def g8_auction_fills(spark, sf_dir):
    """Buys at the confirmed closing auction, sells at the next opening auction."""
    p = pooled(spark, sf_dir).withColumn("order_id", F.concat_ws(":", F.col("date").cast("string"), "symbol"))
    buy = F.col("symbol").cast("int") % 2 == 0
    at = lambda d, hour: F.timestamp_add("HOUR", F.lit(hour), d.cast("timestamp"))
    orders = p.select("order_id", "symbol", F.when(buy, "auction_close").otherwise("auction_open").alias("rule"), at(F.col("date"), 15).alias("placed_at"))
    confirmed = F.when(F.dayofmonth("date") % 7 != 0, F.dayofmonth("date") % 5 != 0)
    auctions = p.select("order_id", F.when(buy, F.col("close")).otherwise(F.col("next_open")).alias("auction_price"), F.when(buy, at(F.col("date"), 16)).otherwise(at(F.col("next_date"), 9)).alias("observed_at"), confirmed.alias("confirmed"))
    return G.auction_fills(orders, auctions).select("order_id", "price", "rule", "status")
