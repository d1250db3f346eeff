"""Queries of bars, ticks and the 15:20 panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import bars as B
from tapewright.operators import evaluate as E
from tapewright.plans import fixtures
from tapewright.plans.oracle import BARS, BARS_TICKS, query, r, rounded, tick

# A second vendor: the same bars stamped a minute later, without every 17th minute.
TOSS = "SELECT * {replace}(CAST(floor((minute+1)/60) AS INT)*10000+((minute+1)%60)*100 AS ts_hms, 'toss' AS vendor) FROM {b} WHERE minute % 17 <> 0"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.bars_1m(spark, sf_dir)


def toss(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).where("minute % 17 <> 0")
    return b.withColumn("ts_hms", F.expr("CAST(floor((minute+1)/60) AS INT)*10000+((minute+1)%60)*100")).withColumn("vendor", F.lit("toss"))


TOSS_SQL = TOSS.format(replace="REPLACE ", b="bars_1m")

# Some days have two vendors, some an unknown one.
_MIXED = "SELECT snapshot_date, symbol, ts_hms, minute, open, high, low, close, volume, value_krw, has_trade, CASE WHEN day(snapshot_date)=7 AND symbol='000010' THEN 'nobody' WHEN day(snapshot_date)=9 AND minute%2=0 THEN 'toss' WHEN day(snapshot_date)=11 THEN 'ls' ELSE vendor END AS vendor FROM {b}"
_SHIFT = "CASE vendor WHEN 'kis' THEN minute+1 WHEN 'ls' THEN minute+1 WHEN 'dbsec' THEN minute+1 WHEN 'kiwoom' THEN minute+1 WHEN 'toss' THEN minute END"
_DECISION = (
    BARS
    + f""", mixed AS ({_MIXED.format(b='bars_1m')}), em AS (SELECT *, {_SHIFT} AS end_min, CASE WHEN vendor='toss' THEN volume*(high+low+close)/3 ELSE value_krw END AS val FROM mixed),
 fl AS (SELECT *, end_min-1 >= 540 AND end_min <= 920 AS inside, end_min-1 >= 540 AND end_min <= 920 AND has_trade AS traded FROM em),
 dec0 AS (SELECT snapshot_date, symbol, min(vendor) vendor, count(DISTINCT vendor) nv, bool_or(vendor='ls') ex, bool_or(end_min IS NULL) us, count(*) FILTER (WHERE traded) n_traded,
   arg_min(open, (end_min, ts_hms)) FILTER (WHERE traded) AS open, max(high) FILTER (WHERE traded) high, min(low) FILTER (WHERE traded) low, arg_max(close, (end_min, ts_hms)) FILTER (WHERE traded) AS close, CAST(sum(volume) FILTER (WHERE inside) AS BIGINT) volume, sum(val) FILTER (WHERE inside) value_krw FROM fl GROUP BY 1,2),
 dec AS (SELECT *, CASE WHEN ex THEN 'vendor_excluded' WHEN us THEN 'unknown_stamp' WHEN nv>1 THEN 'mixed_vendor' WHEN n_traded=0 THEN 'no_traded_bar' WHEN least(open,high,low,close)<=0 OR low>high THEN 'invalid_price' END reason FROM dec0)"""
)


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = spark.sql(_MIXED, b=bars(spark, sf_dir))
    return B.decision_bars(mixed, excluded=("ls",))


@query(_DECISION + f" SELECT snapshot_date, symbol, vendor, n_traded, open, high, low, close, volume, {r('value_krw', 2)} value_krw, reason FROM dec")
def b1_decision_bars(spark, sf_dir):
    return decision(spark, sf_dir).withColumn("value_krw", F.round("value_krw", 2))


@query(BARS + f" SELECT vendor, ts_hms, min(end_min) end_min, count(*) n FROM (SELECT *, {_SHIFT} AS end_min FROM (SELECT * FROM bars_1m UNION ALL BY NAME {TOSS_SQL})) GROUP BY 1,2".replace("{_SHIFT}", _SHIFT).replace("WHEN 'toss' THEN minute END", "WHEN 'toss' THEN minute+1 END"))
def b2_end_minute(spark, sf_dir):
    both = bars(spark, sf_dir).unionByName(toss(spark, sf_dir))
    return both.groupBy("vendor", "ts_hms").agg(F.min(B.end_minute(F.col("ts_hms"), F.col("vendor"))).alias("end_min"), F.count("*").alias("n"))


@query(BARS + f" SELECT snapshot_date, symbol, count(*) n, {r('sum(volume*(high+low+close)/3)', 1)} value_krw FROM ({TOSS_SQL}) GROUP BY 1,2")
def b3_typical_value(spark, sf_dir):
    return B.typical_value(toss(spark, sf_dir)).groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("value_krw"), 1).alias("value_krw"))


@query(
    BARS
    + """, nm AS (SELECT snapshot_date, vendor FROM bars_1m GROUP BY 1,2 HAVING count(DISTINCT symbol) FILTER (WHERE has_trade) >= 3), grid AS (SELECT snapshot_date, vendor, CAST(minute AS INT) AS minute FROM nm, range(540, 930) t(minute)),
 c AS (SELECT snapshot_date, vendor, minute, count(DISTINCT symbol) n FROM bars_1m WHERE has_trade GROUP BY 1,2,3), f AS (SELECT g.*, coalesce(n,0) n FROM grid g LEFT JOIN c USING (snapshot_date, vendor, minute)), m AS (SELECT *, quantile_cont(n,0.5) OVER (PARTITION BY snapshot_date, vendor) median FROM f)
 SELECT snapshot_date, vendor, minute, n, median FROM m WHERE n < 0.8e0*median"""
)
def b4_vendor_gaps(spark, sf_dir):
    return B.vendor_gaps(bars(spark, sf_dir), share=0.8, least_symbols=3)


# The previous session's closes stand in for the history; splits at two places.
_HIST = """SELECT snapshot_date, symbol, true AS in_history, CASE WHEN day(snapshot_date)=5 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, lag(c) OVER w AS prev_close, CASE WHEN day(snapshot_date)=20 THEN 2.0e0 ELSE 1.0e0 END AS factor,
 CASE WHEN day(snapshot_date)%6=0 THEN NULL ELSE lag(c) OVER w * 100 END AS prev_cap FROM (SELECT snapshot_date, symbol, max_by(close, minute) AS c FROM {b} GROUP BY 1,2) WHERE day(snapshot_date) <> 13 WINDOW w AS (PARTITION BY symbol ORDER BY snapshot_date)"""
_OPEN = "SELECT snapshot_date, symbol, CASE WHEN day(snapshot_date)%8=0 THEN 1.0e0 ELSE min_by(open, minute) END AS official_open FROM {b} GROUP BY 1,2,day(snapshot_date)"


@query(
    _DECISION
    + f""", h AS ({_HIST.format(b='bars_1m')}), oo AS ({_OPEN.format(b='bars_1m')}), op AS (SELECT snapshot_date, symbol, min(low) fl, max(high) fh FROM bars_1m WHERE minute < 570 AND has_trade GROUP BY 1,2),
 j AS (SELECT d.*, op.fl, op.fh, h.in_history, h.market, h.prev_close*h.factor AS prev, h.prev_cap, oo.official_open FROM dec d LEFT JOIN op USING (snapshot_date, symbol) LEFT JOIN h USING (snapshot_date, symbol) LEFT JOIN oo USING (snapshot_date, symbol))
 SELECT snapshot_date, symbol, prev AS prev_close_raw, {r('prev_cap*close/prev', 2)} AS cap, coalesce(reason, CASE WHEN in_history IS NULL THEN 'not_in_history' WHEN prev IS NULL OR prev<=0 THEN 'prev_close'
  WHEN NOT coalesce(official_open BETWEEN fl - {tick('official_open', "coalesce(market,'UNKNOWN')", 'snapshot_date')} AND fh + {tick('official_open', "coalesce(market,'UNKNOWN')", 'snapshot_date')}, false) THEN 'head_truncated' WHEN prev_cap IS NULL THEN 'prev_cap' END) day_reason FROM j"""
)
def b5_decision_day_rows(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = B.decision_day_rows(decision(spark, sf_dir), B.opening_range(b, 30), spark.sql(_HIST, b=b), spark.sql(_OPEN, b=b))
    return out.select("snapshot_date", "symbol", "prev_close_raw", F.round("cap", 2).alias("cap"), "day_reason")


_SUPER = "SELECT DISTINCT snapshot_date, s.symbol, s.symbol='000099' AS adjusted FROM {b} CROSS JOIN (SELECT DISTINCT symbol FROM {b} UNION SELECT '000098' UNION SELECT '000099') s"


@query(
    _DECISION
    + f""", live AS (SELECT snapshot_date, symbol, CAST(NULL AS VARCHAR) reason, 'live' AS source FROM dec WHERE day(snapshot_date)%3=0), b6 AS (SELECT * FROM live UNION ALL SELECT snapshot_date, symbol, reason, 'bars' FROM dec d WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.snapshot_date=d.snapshot_date AND l.symbol=d.symbol)),
 sup AS ({_SUPER.format(b='bars_1m')}), j AS (SELECT s.snapshot_date, s.symbol, source, CASE WHEN source IS NULL THEN CASE WHEN adjusted THEN 'price_basis_adjusted' ELSE 'not_fetched' END ELSE reason END cause FROM sup s LEFT JOIN b6 USING (snapshot_date, symbol))
 SELECT snapshot_date, count(*) n_superset, count(*) FILTER (WHERE cause IS NULL) n_rows, count(*) FILTER (WHERE source='live') n_live, count(*) FILTER (WHERE cause='not_fetched') n_not_fetched, count(*) FILTER (WHERE cause='price_basis_adjusted') n_adjusted, {r('count(*) FILTER (WHERE cause IS NULL)/CAST(count(*) AS DOUBLE)')} coverage FROM j GROUP BY 1"""
)
def b6_panel_coverage(spark, sf_dir):
    d, b = decision(spark, sf_dir), bars(spark, sf_dir)
    live = d.where("day(snapshot_date)%3=0").select("snapshot_date", "symbol", F.lit(None).cast("string").alias("reason"))
    return rounded(B.panel_build(live, d, spark.sql(_SUPER, b=b))[1])


_PATH = (
    BARS
    + """, pb AS (SELECT *, minute+1 AS end_min, ln(close/lag(close) OVER (PARTITION BY snapshot_date, symbol ORDER BY minute)) lr, (high+low+close)/3 tp FROM bars_1m WHERE minute+1 > 540 AND minute+1 <= 920),
 pg AS (SELECT snapshot_date, symbol, count(*) n_bars, arg_min(open, end_min) o, arg_max(close, end_min) l, arg_max(close, end_min) FILTER (WHERE end_min<=570) c570, arg_max(close, end_min) FILTER (WHERE end_min<=720) c720, arg_max(close, end_min) FILTER (WHERE end_min<=860) c860, arg_max(close, end_min) FILTER (WHERE end_min<=890) c890,
  sum(tp*volume)/nullif(sum(volume),0) vwap, coalesce(sum(volume) FILTER (WHERE end_min>860),0)/nullif(sum(volume),0) l60, coalesce(sum(volume) FILTER (WHERE end_min>890),0)/nullif(sum(volume),0) l30,
  arg_min(end_min, (-high, end_min)) hi, arg_min(end_min, (low, end_min)) lo, stddev_pop(lr)*sqrt(count(lr)) rv, CASE WHEN count(lr) FILTER (WHERE end_min>860) > 5 THEN stddev_pop(lr) FILTER (WHERE end_min>860) END rvl, avg(CASE WHEN volume<=0 THEN 1.0 ELSE 0.0 END) z FROM pb GROUP BY 1,2 HAVING count(*) >= 30)"""
)


@query(
    _PATH
    + f" SELECT snapshot_date, symbol, n_bars, {r('l/c890-1')} x_r30, {r('l/c860-1')} x_r60, {r('l/c720-1')} x_r_pm, {r('c720/o-1')} x_r_am, {r('c570/o-1')} x_r_open30, {r('l/vwap-1')} x_vwap_dev, {r('l60')} x_late60, {r('l30')} x_late30, {r('(hi-540)/380.0e0')} x_t_high, {r('(lo-540)/380.0e0')} x_t_low, {r('rv')} x_rv1m, {r('rvl')} x_rv_late, {r('z')} x_zero_vol FROM pg"
)
def b7_path_features(spark, sf_dir):
    return rounded(B.path_features(bars(spark, sf_dir)))


@query(_PATH + f", j AS (SELECT d.snapshot_date, d.symbol, l/c890-1 AS x_r30 FROM (SELECT DISTINCT snapshot_date, symbol FROM bars_1m) d LEFT JOIN pg USING (snapshot_date, symbol)) SELECT snapshot_date, symbol, {r('avg(CASE WHEN x_r30 IS NULL THEN 0.0 ELSE 1.0 END) OVER w')} least_share, avg(CASE WHEN x_r30 IS NULL THEN 0.0 ELSE 1.0 END) OVER w >= 0.8e0 AS ok FROM j WINDOW w AS (PARTITION BY snapshot_date)")
def b8_attach_with_floor(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = B.attach_with_floor(b.select("snapshot_date", "symbol").distinct(), [B.path_features(b)], ["snapshot_date", "symbol"], ["x_r30"])
    return rounded(out.select("snapshot_date", "symbol", "least_share", "ok"))


@query(
    BARS
    + f""", g AS (SELECT snapshot_date, symbol, count(*) FILTER (WHERE minute<920) n_continuous, arg_max(close, minute) FILTER (WHERE minute<920) continuous_close, arg_max(close, minute) FILTER (WHERE minute>=920) auction_close, coalesce(sum(volume) FILTER (WHERE minute>=920),0) av, coalesce(sum(value_krw) FILTER (WHERE minute>=920),0) aval, sum(volume) dv, sum(value_krw) dval FROM bars_1m GROUP BY 1,2)
 SELECT snapshot_date, symbol, n_continuous, continuous_close, auction_close, {r('CASE WHEN n_continuous>=10 THEN (auction_close/continuous_close-1)*1e4 END')} impact_bp, {r('av/nullif(dv,0)')} volume_share, {r('aval/nullif(dval,0)')} value_share FROM g"""
)
def b9_auction_impact(spark, sf_dir):
    out = B.auction_impact(bars(spark, sf_dir))
    return rounded(out.select("snapshot_date", "symbol", "n_continuous", "continuous_close", "auction_close", "impact_bp", "volume_share", "value_share"))


@query(BARS + f" SELECT snapshot_date, CAST(sum(volume) FILTER (WHERE minute>=920) AS BIGINT) auction_volume, {r('sum(value_krw) FILTER (WHERE minute>=920)', 1)} auction_value FROM bars_1m GROUP BY 1")
def b10_auction_liquidity(spark, sf_dir):
    return B.auction_impact(bars(spark, sf_dir)).groupBy("snapshot_date").agg(F.sum("auction_volume").cast("long").alias("auction_volume"), F.round(F.sum("auction_value"), 1).alias("auction_value"))


@query(BARS + " SELECT snapshot_date, symbol, count(*) FILTER (WHERE minute%10<>3) n_kept FROM bars_1m GROUP BY 1,2")
def b11_collapse_duplicates(spark, sf_dir):
    b = bars(spark, sf_dir)
    doubled = b.unionByName(b).unionByName(b.where("minute%10=3").withColumn("close", F.col("close") + 1))
    once, _ = B.collapse_duplicates(doubled, ["snapshot_date", "symbol", "ts_hms"])
    return once.groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n_kept"))


@query(BARS + ", g AS (SELECT snapshot_date, symbol, count(*) n_bars, min(minute) first_min, max(minute) last_min FROM bars_1m GROUP BY 1,2), f AS (SELECT *, n_bars < 0.8e0*max(n_bars) OVER (PARTITION BY snapshot_date) AS few, first_min > 545 AS late_start, last_min < 925 AS early_end FROM g) SELECT * FROM f WHERE few OR late_start OR early_end")
def b12_coverage_outliers(spark, sf_dir):
    return B.coverage_outliers(bars(spark, sf_dir), edge=5)


@query(BARS + " SELECT snapshot_date, symbol, CASE WHEN day(snapshot_date)%4=1 THEN 'uncertified' END AS reason, count(*) n FROM bars_1m GROUP BY 1,2,3")
def b13_certified_admission(spark, sf_dir):
    b = bars(spark, sf_dir)
    return B.certified_admission(b, b.where("day(snapshot_date)%4<>1").select("snapshot_date", "symbol").distinct()).groupBy("snapshot_date", "symbol", "reason").agg(F.count("*").alias("n"))


_LOSSY = "SELECT * FROM {t} WHERE NOT (day(snapshot_date)%5=2 AND event_id%9=0) AND NOT (day(snapshot_date)%5=4 AND symbol='000030' AND event_id%50=0)"
_VOL = BARS_TICKS + f", tk AS ({_LOSSY.format(t='ticks')}), v AS (SELECT coalesce(b.snapshot_date,t.snapshot_date) snapshot_date, coalesce(b.symbol,t.symbol) symbol, bar_volume, tick_volume FROM (SELECT snapshot_date, symbol, CAST(sum(volume) AS BIGINT) bar_volume FROM bars_1m WHERE minute<930 GROUP BY 1,2) b FULL JOIN (SELECT snapshot_date, symbol, CAST(sum(volume) AS BIGINT) tick_volume FROM tk GROUP BY 1,2) t ON b.snapshot_date=t.snapshot_date AND b.symbol=t.symbol), rel AS (SELECT *, CASE WHEN coalesce(tick_volume,0) < coalesce(bar_volume,0)*0.99e0 THEN 'TICK_SHORT' ELSE 'CONSISTENT' END relation FROM v)"


def relations(spark: SparkSession, sf_dir: str, session: str = "regular") -> DataFrame:
    t = spark.sql(_LOSSY, t=fixtures.ticks(spark, sf_dir))
    return B.tick_bar_relation(B.comparable_volumes(bars(spark, sf_dir), t, session), session)


@query(_VOL + " SELECT * FROM v")
def b14_comparable_volumes(spark, sf_dir):
    return relations(spark, sf_dir).drop("relation")


@query(_VOL + " SELECT * FROM rel")
def b15_tick_bar_relation(spark, sf_dir):
    return relations(spark, sf_dir)


@query(_VOL + f", k AS (SELECT r.*, 1-coalesce(tick_volume,0)/CAST(bar_volume AS DOUBLE) gap, day(snapshot_date)%2=0 AS cert FROM rel r WHERE relation='TICK_SHORT'), k2 AS (SELECT *, CASE WHEN NOT cert THEN 'LOST' WHEN gap <= 0.05e0 THEN 'SOURCE_DIFF' ELSE 'SOURCE_DIFF_EXCESS' END kind FROM k), nm AS (SELECT snapshot_date, count(*) c FROM rel GROUP BY 1) SELECT k2.snapshot_date, symbol, {r('gap')} gap, kind, sum(CASE WHEN kind='SOURCE_DIFF_EXCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY k2.snapshot_date)/CAST(c AS DOUBLE) > 0.05e0 AS systemic FROM k2 JOIN nm ON nm.snapshot_date=k2.snapshot_date")
def b16_shortfall_class(spark, sf_dir):
    rel = relations(spark, sf_dir)
    return rounded(B.shortfall_class(rel, rel.where("day(snapshot_date)%2=0").select("snapshot_date", "symbol")).select("snapshot_date", "symbol", "gap", "kind", "systemic"))


_NAMES = "SELECT DISTINCT snapshot_date, s.symbol FROM {b} CROSS JOIN (SELECT DISTINCT symbol FROM {b} UNION SELECT '000099') s"


@query(BARS + f", nm AS ({_NAMES.format(b='bars_1m')}), per AS (SELECT snapshot_date, symbol, count(DISTINCT minute) FILTER (WHERE minute BETWEEN 540 AND 928) ni, count(DISTINCT minute) FILTER (WHERE NOT minute BETWEEN 540 AND 928) nx FROM bars_1m GROUP BY 1,2) SELECT snapshot_date, count(*) FILTER (WHERE ni IS NULL) missing_symbols, CAST(sum(389-coalesce(ni,0)) AS BIGINT) missing_bars, CAST(sum(coalesce(nx,0)) AS BIGINT) unexpected_bars FROM nm LEFT JOIN per USING (snapshot_date, symbol) GROUP BY 1")
def b17_dense_grid_audit(spark, sf_dir):
    b = bars(spark, sf_dir)
    return B.dense_grid_audit(b, spark.sql(_NAMES, b=b), last=928)


@query(BARS + " SELECT snapshot_date, count(*) n_bars, count(DISTINCT symbol) n_symbols, count(DISTINCT ts_hms) n_stamps FROM bars_1m WHERE NOT minute BETWEEN 545 AND 919 GROUP BY 1")
def b18_sparse_window_audit(spark, sf_dir):
    return B.sparse_window_audit(bars(spark, sf_dir), 545, 919)


_BROKEN = "CASE WHEN minute%23=0 THEN value_krw*1.5e0 ELSE value_krw END"


@query(BARS + f", br AS (SELECT * REPLACE ({_BROKEN} AS value_krw) FROM bars_1m) SELECT snapshot_date, symbol, count(*) n_bad FROM br WHERE NOT value_krw BETWEEN low*volume AND high*volume GROUP BY 1,2")
def b19_value_audit(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("value_krw", F.expr(_BROKEN))
    return b.where(B.value_violation()).groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n_bad"))


@query(BARS + " SELECT snapshot_date, symbol, count(*) n_bad FROM bars_1m WHERE minute%31=0 OR minute%37=0 GROUP BY 1,2")
def b20_price_positivity(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("low", F.expr("CASE WHEN minute%31=0 THEN NULL WHEN minute%37=0 THEN -low ELSE low END"))
    return b.where(B.bad_price()).groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n_bad"))


@query(_VOL.replace("WHERE minute<930 GROUP", "WHERE minute<1200 GROUP") + ", ev AS (SELECT *, CASE WHEN coalesce(tick_volume,0) < coalesce(bar_volume,0) THEN 'TICK_SHORT' WHEN coalesce(tick_volume,0) > coalesce(bar_volume,0)*1.01e0 THEN 'TICK_SURPLUS' ELSE 'CONSISTENT' END r2 FROM v) SELECT snapshot_date, r2 AS relation, count(*) n FROM ev GROUP BY 1,2")
def b21_after_hours_audit(spark, sf_dir):
    return relations(spark, sf_dir, "evening").groupBy("snapshot_date", "relation").agg(F.count("*").alias("n"))


@query(BARS + f", br AS (SELECT * REPLACE ({_BROKEN} AS value_krw) FROM bars_1m) SELECT snapshot_date, symbol, count(*) FILTER (WHERE bad) n_repaired, {r('sum(CASE WHEN bad THEN CASE WHEN volume=0 THEN 0e0 ELSE close*volume END ELSE value_krw END)', 1)} value_krw FROM (SELECT *, NOT value_krw BETWEEN low*volume AND high*volume AS bad FROM br) GROUP BY 1,2")
def b22_repair_value(spark, sf_dir):
    fixed = B.repair_value(bars(spark, sf_dir).withColumn("value_krw", F.expr(_BROKEN)))
    return fixed.groupBy("snapshot_date", "symbol").agg(F.count_if("repaired").alias("n_repaired"), F.round(F.sum("value_krw"), 1).alias("value_krw"))


@query(BARS + ", g AS (SELECT snapshot_date, symbol, count(*) FILTER (WHERE minute%17<>0) n_both, count(*) FILTER (WHERE minute%17=0) only_a FROM bars_1m GROUP BY 1,2) SELECT *, CAST(0 AS BIGINT) only_b, CASE WHEN n_both>0 THEN 1e0 END ohlc_equal, CASE WHEN n_both>0 THEN 1e0 END volume_equal FROM g")
def b23_vendor_equivalence(spark, sf_dir):
    return B.vendor_equivalence(bars(spark, sf_dir), toss(spark, sf_dir))


_EOD = "SELECT snapshot_date, symbol, CAST(sum(volume) * CASE WHEN day(snapshot_date)%4=0 THEN 1.2e0 WHEN day(snapshot_date)%4=1 THEN 0.9e0 ELSE 1.001e0 END AS DOUBLE) AS eod_volume FROM {b} GROUP BY snapshot_date, symbol, day(snapshot_date)"


@query(BARS + f", eod AS ({_EOD.format(b='bars_1m')}), j AS (SELECT b.snapshot_date, b.symbol, CAST(sum(volume) AS BIGINT) bar_volume, max(eod_volume) eod_volume FROM bars_1m b JOIN eod USING (snapshot_date, symbol) GROUP BY 1,2) SELECT snapshot_date, symbol, bar_volume, {r('bar_volume/nullif(eod_volume,0)')} ratio, CASE WHEN eod_volume=0 THEN 'no_volume' WHEN bar_volume/eod_volume < 0.9e0 THEN 'short' WHEN bar_volume/eod_volume > 1.01e0 THEN 'surplus' ELSE 'ok' END verdict FROM j")
def b24_basis_verdict(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(B.basis_verdict(b, spark.sql(_EOD, b=b)).select("snapshot_date", "symbol", "bar_volume", "ratio", "verdict"))


@query(BARS + " SELECT snapshot_date, symbol FROM (SELECT DISTINCT snapshot_date, symbol FROM bars_1m) ORDER BY (day(snapshot_date)*7919 + CAST(symbol AS INT)*104729) % 1009, snapshot_date, symbol LIMIT 40")
def b25_sampled_days(spark, sf_dir):
    days = bars(spark, sf_dir).select("snapshot_date", "symbol").distinct()
    return B.sampled_days(days, 40, (F.dayofmonth("snapshot_date") * 7919 + F.col("symbol").cast("int") * 104729) % 1009)


# All venues' bars: the primary ones with a share of other trading that depends on name and day, and a close a little off.
_CONSOLIDATED = "SELECT snapshot_date, symbol, ts_hms, minute, open, high, low, close*(1+(CAST(symbol AS INT)+day(snapshot_date))%3*0.001e0) AS close, volume + CAST(floor(volume*(2+(CAST(symbol AS INT)*3+day(snapshot_date)*7)%11)/20e0) AS BIGINT) AS volume FROM {b}"
_TOLERANCE, _ALPHAS, _STRUCTURES = 0.15, (0.1, 0.3, 0.5, 0.9), ((1, 30), (2, 60), (2, 120), (3, 400))
_CAL = (
    BARS
    + f""", eod AS ({_EOD.format(b='bars_1m')}), cons AS ({_CONSOLIDATED.format(b='bars_1m')}),
 cg AS (SELECT snapshot_date, symbol, CAST(sum(volume) FILTER (WHERE minute<920) AS DOUBLE) v_krx_1520, CAST(coalesce(sum(volume) FILTER (WHERE minute>=920),0) AS DOUBLE) auction_volume, max(high) FILTER (WHERE minute<920) high_1520, min(low) FILTER (WHERE minute<920) low_1520, arg_max(close,minute) FILTER (WHERE minute<920) close_krx_1519, arg_max(close,minute) close_eod FROM bars_1m GROUP BY 1,2),
 cc AS (SELECT snapshot_date, symbol, CAST(sum(volume) AS DOUBLE) v_cons_1520, arg_max(close,minute) close_cons_1519 FROM cons WHERE minute<920 GROUP BY 1,2),
 calib AS (SELECT * FROM cg JOIN cc USING (snapshot_date, symbol) JOIN eod USING (snapshot_date, symbol)),
 el AS (SELECT *, v_krx_1520/v_cons_1520 true_share FROM calib WHERE eod_volume>0 AND v_krx_1520>0 AND v_cons_1520>0 AND auction_volume>=0 AND abs(eod_volume-(v_krx_1520+auction_volume))/eod_volume <= {_TOLERANCE}e0)"""
)


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CONSOLIDATED, b=bars(spark, sf_dir))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return B.calibration_rows(b, consolidated(spark, sf_dir), spark.sql(_EOD, b=b))


@query(_CAL + f" SELECT snapshot_date, symbol, v_krx_1520, v_cons_1520, auction_volume, {r('eod_volume')} eod_volume, high_1520, low_1520, close_krx_1519, {r('close_cons_1519')} close_cons_1519, close_eod FROM calib")
def b26_calibration_rows(spark, sf_dir):
    return rounded(calibration(spark, sf_dir).select("snapshot_date", "symbol", "v_krx_1520", "v_cons_1520", "auction_volume", "eod_volume", "high_1520", "low_1520", "close_krx_1519", "close_cons_1519", "close_eod"))


_PROXY = ", px AS (SELECT snapshot_date, symbol, true_share, eod_volume*(1-(SELECT avg(auction_volume/eod_volume) FROM el))/v_cons_1520 proxy FROM el)"


def proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = B.eligible_calibration(calibration(spark, sf_dir), _TOLERANCE)
    return B.share_proxies(fit.crossJoin(F.broadcast(B.auction_fraction(fit))), F.col("auction_mean"))


@query(_CAL + _PROXY + f" SELECT snapshot_date, symbol, {r('true_share')} true_share, {r('proxy')} proxy FROM px")
def b27_share_history(spark, sf_dir):
    return rounded(proxies(spark, sf_dir).select("snapshot_date", "symbol", "true_share", "proxy"))


def _ema(values: str, alpha: str) -> str:
    return f"list_reduce({values}, lambda x, y: {alpha}*y + (1e0-{alpha})*x)"


# The proxies of the 120 days before, in order of their dates.
_PREDICTED = (
    _CAL
    + _PROXY
    + f""", pv AS (SELECT a.snapshot_date, a.symbol, count(b.proxy) n_prior, list(b.proxy ORDER BY b.snapshot_date) FILTER (WHERE b.proxy IS NOT NULL) known FROM px a LEFT JOIN px b ON b.symbol=a.symbol AND a.snapshot_date-b.snapshot_date BETWEEN 1 AND 120 GROUP BY 1,2),
 pr0 AS (SELECT snapshot_date, symbol, n_prior, CASE WHEN n_prior>=2 THEN {_ema('known', '0.3e0')}*0.95e0 END p FROM pv), pr AS (SELECT snapshot_date, symbol, n_prior, CASE WHEN p>0 AND p<=1 THEN p END p FROM pr0)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxies(spark, sf_dir).select("snapshot_date", "symbol", "proxy")
    return B.ewma_prediction(rows, 0.3, 2, 120, 0.95).select("snapshot_date", "symbol", "n_prior", "prediction")


@query(_PREDICTED + f" SELECT snapshot_date, symbol, n_prior, {r('p')} prediction FROM pr")
def b28_ewma_prediction(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).withColumn("n_prior", F.col("n_prior").cast("long")))


@query(BARS + f", am AS (SELECT snapshot_date, symbol, arg_max(close,minute) FILTER (WHERE minute<920) c0, arg_max(close,minute) FILTER (WHERE minute>=920) c1, coalesce(sum(value_krw) FILTER (WHERE minute>=920),0)/nullif(sum(value_krw),0) vs FROM bars_1m GROUP BY 1,2) SELECT snapshot_date, symbol, {r('c1/c0-1')} AS move, {r('vs')} value_share FROM am WHERE c0>0 AND c1 IS NOT NULL")
def b31_auction_moves(spark, sf_dir):
    return rounded(B.auction_moves(bars(spark, sf_dir)))


_GRID = ", ".join(f"({a}e0,{m},{g})" for a in _ALPHAS for m, g in _STRUCTURES)
_FIT = (
    _CAL
    + f""", dt AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) i, count(*) OVER () n FROM (SELECT DISTINCT snapshot_date FROM el)),
 pt AS (SELECT snapshot_date, CASE WHEN i <= ceil(n*0.25e0) THEN 'holdout' WHEN i > ceil(n*0.25e0)+greatest(1, floor((n-ceil(n*0.25e0))/2)) THEN 'selection' ELSE 'history' END part FROM dt),
 rw AS (SELECT el.*, part, part='holdout' AS held FROM el JOIN pt USING (snapshot_date)), ab AS (SELECT avg(auction_volume/eod_volume) FILTER (WHERE NOT held) af, avg(auction_volume/eod_volume) FILTER (WHERE held) ah FROM rw),
 px AS (SELECT rw.*, eod_volume*(1-af)/v_cons_1520 proxy FROM rw, ab), gr(al,ml,gap) AS (VALUES {_GRID}),
 ls AS (SELECT a.snapshot_date, a.symbol, a.part, a.true_share, gap, list(b.proxy ORDER BY b.snapshot_date) FILTER (WHERE b.proxy IS NOT NULL) known, count(b.proxy) k FROM px a CROSS JOIN (SELECT DISTINCT gap FROM gr) LEFT JOIN px b ON b.held=a.held AND b.symbol=a.symbol AND a.snapshot_date-b.snapshot_date BETWEEN 1 AND gap GROUP BY 1,2,3,4,5),
 ra AS (SELECT al, ml, gr.gap, part, true_share, CASE WHEN k>=ml THEN {_ema('known', 'al')} END raw FROM ls JOIN gr ON gr.gap=ls.gap),
 bi AS (SELECT al, ml, gap, quantile_cont(true_share/raw, 0.5) bias FROM ra WHERE part='selection' AND raw>0 GROUP BY 1,2,3),
 sc AS (SELECT ra.*, bias, CASE WHEN raw*bias>0 AND raw*bias<=1 THEN raw*bias END share FROM ra LEFT JOIN bi USING (al, ml, gap)),
 fr0 AS (SELECT al, ml, gap, max(bias) bias, count(*) n_rows, count(share)/CAST(count(*) AS DOUBLE) coverage, quantile_cont(abs(share-true_share)/true_share,0.5) p50, quantile_cont(abs(share-true_share)/true_share,0.9) p90, quantile_cont(abs(share-true_share)/true_share,0.99) p99 FROM sc WHERE part='selection' GROUP BY 1,2,3),
 fr AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, p90 NULLS LAST, ml, gap DESC, al) place FROM fr0)"""
)


@query(_FIT + f" SELECT al ewma_alpha, CAST(ml AS INT) min_prior_days, CAST(gap AS INT) max_gap_days, n_rows, {r('bias')} bias, {r('coverage')} coverage, {r('p50')} rel_err_p50, {r('p90')} rel_err_p90, {r('p99')} rel_err_p99, place FROM fr")
def b29_frontier(spark, sf_dir):
    """Every candidate of the grid on the selection rows."""
    return rounded(B.estimator_frontier(B.estimator_rows(calibration(spark, sf_dir), _TOLERANCE, 0.25), _ALPHAS, _STRUCTURES))


@query(
    _FIT
    + f""", be AS (SELECT * FROM fr WHERE p90 <= 0.9e0 ORDER BY place LIMIT 1), ho AS (SELECT sc.* FROM sc JOIN be USING (al, ml, gap) WHERE part='holdout'), hs AS (SELECT true_share, raw, CASE WHEN raw*be.bias>0 AND raw*be.bias<=1 THEN raw*be.bias END share FROM ho, be),
 he AS (SELECT count(*) n_holdout_rows, count(share)/CAST(count(*) AS DOUBLE) cov, quantile_cont(abs(share-true_share)/true_share,0.5) h50, quantile_cont(abs(share-true_share)/true_share,0.9) h90, quantile_cont(abs(share-true_share)/true_share,0.99) h99, quantile_cont(CASE WHEN share IS NOT NULL THEN true_share/raw END,0.5) bh FROM hs),
 cl AS (SELECT quantile_cont(CASE WHEN close_krx_1519>0 AND close_cons_1519>0 THEN abs(close_cons_1519-close_krx_1519)/close_krx_1519*1e4 END,0.9) FILTER (WHERE held) cb, min(snapshot_date) FILTER (WHERE held) holdout_start, max(snapshot_date) FILTER (WHERE held) holdout_end, min(snapshot_date) FILTER (WHERE NOT held) fit_start, max(snapshot_date) FILTER (WHERE NOT held) calibrated_through, count(*) FILTER (WHERE NOT held) n_fit_rows, count(DISTINCT symbol) n_symbols FROM rw)
 SELECT al ewma_alpha, CAST(ml AS INT) min_prior_days, CAST(gap AS INT) max_gap_days, {r('bias')} bias_correction, al IN (0.1e0, 0.9e0) alpha_at_boundary, n_holdout_rows, {r('cov')} holdout_coverage, {r('h50')} holdout_rel_err_p50, {r('h90')} holdout_rel_err_p90, {r('h99')} holdout_rel_err_p99, {r('bh')} bias_holdout, {r('ah')} auction_fraction_holdout, {r('cb')} close_bp_err_p90, holdout_start, holdout_end, {r('af')} auction_fraction_mean, fit_start, calibrated_through, n_fit_rows, n_symbols FROM be, he, cl, ab"""
)
def b29_fit_estimator(spark, sf_dir):
    return rounded(B.fit_estimator(calibration(spark, sf_dir), _ALPHAS, _STRUCTURES, _TOLERANCE, 0.25, 2, 0.9))


@query(_PREDICTED + f" SELECT snapshot_date, symbol, count(*) n, {r('sum(volume*p)', 3)} volume_est, {r('sum(volume*p*(high+low+close)/3)', 1)} value_est, {r('sum(volume*p*(1-0.158e0))', 3)} volume_low, 'krx_reconstructed' basis FROM cons JOIN pr USING (snapshot_date, symbol) WHERE p IS NOT NULL AND minute<920 GROUP BY 1,2")
def b30_reconstruct(spark, sf_dir):
    out = B.reconstruct(consolidated(spark, sf_dir).where("minute < 920"), predictions(spark, sf_dir).where("prediction is not null").drop("n_prior"), 0.158, 10.0)
    return out.groupBy("snapshot_date", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("volume_est"), 3).alias("volume_est"), F.round(F.sum("value_est"), 1).alias("value_est"), F.round(F.sum("volume_low"), 3).alias("volume_low"), F.first("basis").alias("basis"))


_TYPICAL = "sum({v}*(high+low+close)/3)"


@query(
    _PREDICTED
    + f""", kx AS (SELECT snapshot_date, symbol, CAST(sum(volume) AS DOUBLE) vx, {_TYPICAL.format(v='volume')} tx FROM bars_1m WHERE minute<920 GROUP BY 1,2), ky AS (SELECT snapshot_date, symbol, sum(volume*p) vy, {_TYPICAL.format(v='volume*p')} ty FROM cons JOIN pr USING (snapshot_date, symbol) WHERE minute<920 AND p IS NOT NULL GROUP BY 1,2), fx AS (SELECT * FROM kx JOIN ky USING (snapshot_date, symbol)),
 fr AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY tx DESC, symbol) rx, row_number() OVER (PARTITION BY snapshot_date ORDER BY ty DESC, symbol) ry FROM fx)
 SELECT snapshot_date, count(*) n, {r('avg(abs(vy/nullif(vx,0)-1))')} volume_diff, {r('avg(abs(ty/nullif(tx,0)-1))')} value_diff, count(*) FILTER (WHERE rx<=2 AND ry<=2) n_common, {r('CASE WHEN count(*)>1 THEN corr(rx,ry) END')} rank_corr FROM fr GROUP BY 1"""
)
def e22_fidelity(spark, sf_dir):
    """Decision frames of the primary venue's bars against those reconstructed from all venues': features and the two largest by value."""
    shares = predictions(spark, sf_dir).where("prediction is not null").drop("n_prior")
    rebuilt = B.reconstruct(consolidated(spark, sf_dir).where("minute < 920"), shares, 0.158, 10.0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    frame = lambda b, v: b.groupBy("snapshot_date", "symbol").agg(F.sum(v).cast("double").alias("volume"), F.sum(F.col(v) * typical).alias("value"))
    return rounded(E.fidelity(frame(bars(spark, sf_dir).where("minute < 920"), "volume"), frame(rebuilt, "volume_est"), ["volume", "value"], "value", 2))


@query(_VOL + f", nm AS ({_NAMES.format(b='bars_1m')}), j AS (SELECT n.*, CASE WHEN t.symbol IS NULL THEN 'missing' WHEN r.relation='TICK_SHORT' THEN 'short' END why FROM nm n LEFT JOIN (SELECT DISTINCT snapshot_date, symbol FROM tk) t USING (snapshot_date, symbol) LEFT JOIN rel r USING (snapshot_date, symbol)) SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY why, symbol) walk FROM j WHERE why IS NOT NULL")
def b32_needed_tapes(spark, sf_dir):
    b, rel = bars(spark, sf_dir), relations(spark, sf_dir)
    have = spark.sql(_LOSSY, t=fixtures.ticks(spark, sf_dir)).select("snapshot_date", "symbol").distinct()
    return B.needed_tapes(spark.sql(_NAMES, b=b), have, rel)
