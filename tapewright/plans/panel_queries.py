"""Queries of the daily panel and of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import market as M
from tapewright.operators import calendar as C
from tapewright.operators import panel as P
from tapewright.plans import fixtures
from tapewright.plans.oracle import PREP, change, lit_date, query, r, rounded, tax, tick, tick_bp


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepare_price_panel(fixtures.price_history(spark, sf_dir), padded=True)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions(fixtures.price_history(spark, sf_dir))


@query(PREP + f" SELECT date, symbol, market, close, {r('chg_ratio')} chg_ratio, {r('tv_clean')} tv_clean, {r('mc_clean')} mc_clean, is_ceiling, {r('tick_cost_bp')} tick_cost_bp FROM prep")
def p1_prepare_panel(spark, sf_dir):
    return rounded(prepared(spark, sf_dir).select("date", "symbol", "market", "close", "chg_ratio", "tv_clean", "mc_clean", "is_ceiling", "tick_cost_bp"))


@query(
    PREP
    + """ SELECT count(*) n_rows, count(DISTINCT symbol) n_symbols, count(DISTINCT date) n_dates, min(date) first_date, max(date) last_date,
 count(*) FILTER (WHERE prev_close IS NULL) n_no_prev, count(*) FILTER (WHERE chg_ratio IS NULL) n_no_change, count(*) FILTER (WHERE prev_close > 0 AND chg_ratio IS NULL) n_beyond_limit,
 count(*) FILTER (WHERE trade_value_100m IS NULL) n_value_rebuilt, count(*) FILTER (WHERE market_cap_100m IS NULL) n_cap_missing, count(*) FILTER (WHERE market_cap_100m IS NULL AND mc_clean IS NOT NULL) n_cap_filled,
 count(*) FILTER (WHERE is_ceiling) n_ceiling, count(*) FILTER (WHERE market='UNKNOWN') n_market_unknown, count(*) FILTER (WHERE tick_cost_bp IS NULL) n_no_tick_cost FROM prep"""
)
def p1_provenance(spark, sf_dir):
    return P.panel_provenance(prepared(spark, sf_dir))


@query(PREP + f" SELECT date, symbol, {r(change('close', 'prev_close'))} chg_ratio, {r('close/prev_close-1')} raw_ratio FROM price_history WHERE prev_close IS NOT NULL")
def p2_change_ratio(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).where("prev_close is not null")
    return rounded(p.select("date", "symbol", M.change_ratio(F.col("close"), F.col("prev_close")).alias("chg_ratio"), (F.col("close") / F.col("prev_close") - 1).alias("raw_ratio")))


_STORED = "CASE WHEN day(date)%5=0 THEN chg_ratio*100 ELSE chg_ratio END"


@query(PREP + f" SELECT date, symbol, {r('stored')} stored, {r('chg_ratio')} chg_ratio FROM (SELECT *, {_STORED} stored FROM prep) WHERE abs(stored-chg_ratio*100) <= 1e-4*abs(chg_ratio*100) AND NOT abs(stored-chg_ratio) <= 1e-4*abs(chg_ratio)")
def p3_mixed_units(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn("stored", F.when(F.dayofmonth("date") % 5 == 0, F.col("chg_ratio") * 100).otherwise(F.col("chg_ratio")))
    return rounded(P.mixed_unit_report(p, "stored").select("date", "symbol", "stored", "chg_ratio"))


@query(PREP + f" SELECT date, symbol, {r('chg_ratio')} chg_ratio, close, high FROM prep WHERE is_ceiling")
def p4_ceilings(spark, sf_dir):
    return rounded(prepared(spark, sf_dir).where("is_ceiling").select("date", "symbol", "chg_ratio", "close", "high"))


_HOLES = "SELECT * REPLACE (CASE WHEN day(date)%7=0 THEN NULL ELSE prev_close END AS prev_close) FROM price_history"


@query(
    PREP
    + f""", holes AS ({_HOLES}), healed AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) prior FROM holes),
 fixed AS (SELECT date, symbol, close, prev_close IS NULL AND prior IS NOT NULL AS healed, coalesce(prev_close, prior) prev_close FROM healed)
 SELECT date, symbol, healed, prev_close, {r(change())} chg_ratio FROM fixed"""
)
def p5_heal_previous_close(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).withColumn("prev_close", F.when(F.dayofmonth("date") % 7 != 0, F.col("prev_close")))
    return rounded(P.heal_previous_close(p).select("date", "symbol", "healed", "prev_close", "chg_ratio"))


@query(PREP + " SELECT count(*) n_checked FROM prep WHERE chg_ratio IS NOT NULL")
def p6_unit_assertion(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn("stored", F.col("chg_ratio"))
    return P.assert_units(p, "stored").where("stored is not null").agg(F.count("*").alias("n_checked"))


@query(
    PREP
    + f""" SELECT date, count(*) FILTER (WHERE chg_ratio > 0) advances, count(*) FILTER (WHERE chg_ratio < 0) declines,
 {r("(count(*) FILTER (WHERE chg_ratio > 0) - count(*) FILTER (WHERE chg_ratio < 0)) / CAST(nullif(count(*) FILTER (WHERE chg_ratio <> 0),0) AS DOUBLE)")} breadth
 FROM prep WHERE date = (SELECT max(date) FROM prep WHERE date < DATE '2023-06-15') GROUP BY date"""
)
def p7_latest_breadth(spark, sf_dir):
    return rounded(P.latest_breadth(prepared(spark, sf_dir), "2023-06-15"))


# Splits at fixed places: the base is half, or a fifth, of the close before.
_BASE = "CASE WHEN prev_close IS NULL THEN NULL WHEN CAST(symbol AS INT)%10=3 AND month(date)=6 AND day(date)<4 THEN floor(prev_close/2) WHEN CAST(symbol AS INT)%10=7 AND month(date)=9 AND day(date)>27 THEN floor(prev_close/5) ELSE prev_close END"
_EVENTS = (
    PREP
    + f""", based AS (SELECT *, CAST({_BASE} AS DOUBLE) base_price FROM price_history),
 prior AS (SELECT b.*, lag(close_raw) OVER w pc, lag(b.date) OVER w pd, cal.prev_date FROM based b JOIN cal ON cal.date=b.date WINDOW w AS (PARTITION BY symbol ORDER BY b.date)),
 ev0 AS (SELECT *, coalesce(abs(base_price-pc) > 0.5e0, false) off_, coalesce(pd = prev_date, false) consecutive FROM prior),
 ev AS (SELECT *, off_ AND consecutive AS event, off_ AND NOT consecutive AS gap_jump, CASE WHEN off_ AND consecutive THEN base_price/pc ELSE 1e0 END factor,
   CASE WHEN off_ AND consecutive THEN pc/base_price END implied_share_ratio FROM ev0),
 adj AS (SELECT *, coalesce(product(factor) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1e0) AS scale FROM ev)"""
)


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.price_history(spark, sf_dir).withColumn("base_price", F.expr(_BASE).cast("double"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.base_price_events(based(spark, sf_dir), calendar(spark, sf_dir))


@query(_EVENTS + f" SELECT date, symbol, base_price, event, gap_jump, {r('factor')} factor, {r('implied_share_ratio')} implied_share_ratio FROM ev WHERE off_")
def p8_base_price_events(spark, sf_dir):
    return rounded(events(spark, sf_dir).where("event or gap_jump").select("date", "symbol", "base_price", "event", "gap_jump", "factor", "implied_share_ratio"))


@query(_EVENTS + f" SELECT date, symbol, close_raw, {r('scale')} AS scale, {r('close*scale', 4)} AS close, {r('open*scale', 4)} AS open, {r('prev_close*scale', 4)} AS prev_close FROM adj")
def p9_back_adjust(spark, sf_dir):
    a = P.back_adjust(events(spark, sf_dir))
    return a.select("date", "symbol", "close_raw", F.round("scale", 6).alias("scale"), *(F.round(c, 4).alias(c) for c in ("close", "open", "prev_close")))


@query(
    _EVENTS
    + f""", flagged AS (SELECT * REPLACE (CASE WHEN date >= DATE '2025-01-01' THEN factor ELSE 1e0 END AS factor, event AND date >= DATE '2025-01-01' AS event), date >= DATE '2025-01-01' AS is_new FROM ev),
 rescaled AS (SELECT *, coalesce(product(factor) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1e0) AS scale FROM flagged)
 SELECT date, symbol, is_new, event, {r('scale')} AS scale, {r('close*scale', 4)} AS close FROM rescaled WHERE is_new OR abs(scale-1) > 1e-12"""
)
def p10_merge_and_adjust(spark, sf_dir):
    b = based(spark, sf_dir)
    out = P.merge_and_adjust(b.where("date < date'2025-01-01'"), b.where("date >= date'2025-01-01'"), calendar(spark, sf_dir))
    return out.where("changed").select("date", "symbol", "is_new", "event", F.round("scale", 6).alias("scale"), F.round("close", 4).alias("close"))


_SHARES = "SELECT date, symbol, CASE WHEN day(date)%3=1 THEN factor WHEN day(date)%3=2 THEN factor*1.5e0 END AS vendor_factor, CASE WHEN month(date)=9 THEN implied_share_ratio END AS share_ratio FROM {ev} WHERE event"


@query(
    _EVENTS
    + f""", shares AS ({_SHARES.format(ev='ev')})
 SELECT e.date, e.symbol, {r('factor')} factor, CASE WHEN coalesce(abs(vendor_factor/factor-1) <= 0.02e0, false) THEN 'confirmed' WHEN coalesce(abs(share_ratio/implied_share_ratio-1) <= 0.02e0, false) THEN 'corroborated' WHEN vendor_factor IS NOT NULL THEN 'rejected' ELSE 'unverified' END verdict
 FROM ev e LEFT JOIN shares s ON s.date=e.date AND s.symbol=e.symbol WHERE event"""
)
def p12_adjudicate(spark, sf_dir):
    ev = events(spark, sf_dir).where("event")
    shares = spark.sql(_SHARES.format(ev="{ev}"), ev=ev)
    return rounded(P.adjudicate(ev, shares).select("date", "symbol", "factor", "verdict"))


@query(
    _EVENTS
    + """, d AS (SELECT *, event AND day(date)%2=1 AS disagrees FROM ev), calm AS (SELECT *, row_number() OVER (ORDER BY date, symbol)-1 AS p, count(*) OVER () AS n FROM d WHERE NOT disagrees)
 SELECT date, symbol, 'disagrees' AS role FROM d WHERE disagrees UNION ALL SELECT date, symbol, 'control' FROM calm WHERE n <= 50 OR p=0 OR (p*50)//n <> ((p-1)*50)//n"""
)
def p11_event_sample(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("disagrees", F.col("event") & (F.dayofmonth("date") % 2 == 1))
    return P.event_sample(d, 50).select("date", "symbol", "role")


@query(PREP + " SELECT a.date, a.symbol, b.inst_netbuy, b.foreign_netbuy FROM price_history a LEFT JOIN (SELECT * FROM price_history WHERE day(date)%4<>0) b ON a.date=b.date AND a.symbol=b.symbol")
def p13_carry_flows(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return P.carry_flows(p, p.where("day(date)%4<>0"), ("inst_netbuy", "foreign_netbuy")).select("date", "symbol", "inst_netbuy", "foreign_netbuy")


_OLD = "SELECT date, symbol, CASE WHEN day(date)%9=0 THEN close_raw+1 ELSE close_raw END AS close_raw FROM {p} UNION ALL SELECT date, lpad(CAST(CAST(symbol AS INT)+900000 AS {text}),6,'0'), close_raw FROM {p} WHERE day(date)=15"


@query(
    PREP
    + f""", old AS ({_OLD.format(p='price_history', text='VARCHAR')}), ours AS (SELECT date, symbol, count(*) k, max(close_raw) close_raw FROM price_history GROUP BY 1,2)
 SELECT coalesce(o.date, x.date) AS date, CAST(coalesce(sum(k),0) AS BIGINT) n_rows, CAST(coalesce(sum(CASE WHEN k>1 THEN k-1 END),0) AS BIGINT) n_duplicates, count(*) FILTER (WHERE o.close_raw<=0) n_bad_raw, count(x.close_raw) n_old,
 {r("avg(CASE WHEN o.close_raw = x.close_raw THEN 1.0 WHEN o.close_raw <> x.close_raw THEN 0.0 END)")} match_rate, coalesce(sum(k),0) < count(x.close_raw)*0.97 AS shrunk
 FROM ours o FULL JOIN old x ON x.date=o.date AND x.symbol=o.symbol GROUP BY 1"""
)
def p14_validate_rebuild(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return rounded(P.validate_rebuild(p, spark.sql(_OLD.format(p="{p}", text="STRING"), p=p)))


@query(
    PREP
    + """ SELECT date, count(*) FILTER (WHERE close<=0) bad_close, count(*) FILTER (WHERE prev_close<=0) bad_base, count(*) FILTER (WHERE abs(close/prev_close-1-stored_rate) > 0.005e0) rate_mismatch,
 count(*) FILTER (WHERE low>high OR open>high OR open<low OR close>high OR close<low) bad_ohlc FROM (SELECT *, CASE WHEN CAST(symbol AS INT)%13=0 THEN chg_ratio+0.01e0 ELSE chg_ratio END stored_rate FROM prep) GROUP BY date"""
)
def p15_day_block(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn("stored_rate", F.when(F.col("symbol").cast("int") % 13 == 0, F.col("chg_ratio") + 0.01).otherwise(F.col("chg_ratio")))
    return P.day_block_failures(p)


@query(
    PREP
    + f""", j AS (SELECT coalesce(t.date, y.date) AS date, t.symbol IS NOT NULL is_t, y.symbol IS NOT NULL is_y, t.open=y.open AND t.high=y.high AND t.low=y.low AND t.close=y.close AND t.volume=y.volume AS same
   FROM price_history t FULL JOIN (SELECT c.date, p.symbol, open, high, low, close, volume FROM price_history p JOIN cal c ON c.prev_date=p.date) y ON y.date=t.date AND y.symbol=t.symbol),
 g AS (SELECT date, count(*) FILTER (WHERE is_t) n_rows, count(*) FILTER (WHERE is_y) n_before, count(*) FILTER (WHERE same) n_stale, count(*) FILTER (WHERE is_t AND is_y) n_common FROM j GROUP BY 1)
 SELECT *, {r('n_stale/CAST(nullif(n_common,0) AS DOUBLE)')} stale_share, (n_before=0 OR n_rows >= 0.97e0*n_before) AND coalesce(n_stale/CAST(nullif(n_common,0) AS DOUBLE) <= 0.05e0, true) AS ok FROM g"""
)
def p16_day_continuity(spark, sf_dir):
    return rounded(P.day_continuity(fixtures.price_history(spark, sf_dir), calendar(spark, sf_dir)))


_GAPS = "SELECT * {except_}(program_netbuy), CASE WHEN (CAST(symbol AS INT)+day(date))%6=0 THEN NULL ELSE program_netbuy END AS program_netbuy FROM {p}"


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_GAPS.format(except_="EXCEPT", p="{p}"), p=fixtures.price_history(spark, sf_dir))


_GAPPED = PREP + ", gapped AS (" + _GAPS.format(except_="EXCLUDE", p="price_history") + ")"


@query(_GAPPED + f" SELECT date, count(*) n_traded, {r('avg(CASE WHEN inst_netbuy IS NOT NULL AND foreign_netbuy IS NOT NULL AND program_netbuy IS NOT NULL THEN 1.0 ELSE 0.0 END)')} coverage FROM gapped WHERE volume > 0 GROUP BY date")
def p17_flow_coverage(spark, sf_dir):
    return rounded(P.flow_coverage(gapped(spark, sf_dir)))


@query(_GAPPED + " SELECT symbol, count(*) n_missing, min(date) first_missing FROM gapped WHERE date BETWEEN DATE '2022-01-01' AND DATE '2022-12-31' AND program_netbuy IS NULL GROUP BY symbol")
def p18_flow_repair_plan(spark, sf_dir):
    return P.flow_repair_plan(gapped(spark, sf_dir), "2022-01-01", "2022-12-31")


@query(_GAPPED + " SELECT g.date, g.symbol, coalesce(g.program_netbuy, CASE WHEN year(g.date)>=2022 THEN p.program_netbuy END) AS program_netbuy FROM gapped g LEFT JOIN price_history p ON p.date=g.date AND p.symbol=g.symbol")
def p18_fill_flows(spark, sf_dir):
    full = fixtures.price_history(spark, sf_dir).where("year(date)>=2022")
    return P.fill_flows(gapped(spark, sf_dir), full, ("program_netbuy",)).select("date", "symbol", "program_netbuy")


_INDEX = (
    PREP
    + """, idx0 AS (SELECT date, avg(CASE WHEN market='KOSPI' THEN chg_ratio END) kospi_pct, avg(CASE WHEN market='KOSDAQ' THEN chg_ratio END) kosdaq_pct FROM prep GROUP BY date),
 idx1 AS (SELECT *, 100*exp(sum(ln(1+coalesce(kospi_pct,0))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) kospi_level, 100*exp(sum(ln(1+coalesce(kosdaq_pct,0))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) kosdaq_level FROM idx0),
 idx2 AS (SELECT *, ln(kospi_level/lag(kospi_level) OVER (ORDER BY date)) l1, ln(kosdaq_level/lag(kosdaq_level) OVER (ORDER BY date)) l2 FROM idx1),
 idx AS (SELECT *, CASE WHEN count(l1) OVER v = 20 THEN stddev_pop(l1) OVER v * sqrt(252)*100 END v_kospi, CASE WHEN count(l2) OVER v = 20 THEN stddev_pop(l2) OVER v * sqrt(252)*100 END v_kosdaq FROM idx2 WINDOW v AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
)


@query(_INDEX + f" SELECT date, {r('kospi_pct')} kospi_pct, {r('kosdaq_pct')} kosdaq_pct, {r('kospi_level', 1)} kospi_level, {r('kosdaq_level', 1)} kosdaq_level, {r('v_kospi', 4)} v_kospi, {r('v_kosdaq', 4)} v_kosdaq FROM idx")
def p19_index_and_proxies(spark, sf_dir):
    out = P.index_by_date(prepared(spark, sf_dir))
    return out.select("date", *(F.round(c, 6).alias(c) for c in ("kospi_pct", "kosdaq_pct")), *(F.round(c, 1).alias(c) for c in ("kospi_level", "kosdaq_level")), *(F.round(c, 4).alias(c) for c in ("v_kospi", "v_kosdaq")))


@query(
    PREP
    + f""", lv AS (SELECT symbol, date, close AS level FROM price_history), today AS (SELECT symbol, max(date) AS date FROM lv GROUP BY 1), l AS (SELECT lv.symbol, lv.date, ln(level/lag(level) OVER (PARTITION BY lv.symbol ORDER BY lv.date)) lr FROM lv),
 v AS (SELECT *, count(lr) OVER w n, stddev_pop(lr) OVER w s FROM l WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT v.symbol, v.date, {r('CASE WHEN n=20 THEN s*sqrt(252)*100 END', 4)} vol_proxy FROM v JOIN today t ON t.symbol=v.symbol AND t.date=v.date"""
)
def p20_live_proxy(spark, sf_dir):
    lv = fixtures.price_history(spark, sf_dir).select("symbol", "date", F.col("close").alias("level"))
    today = lv.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("level", "date").alias("level"))
    return P.live_proxy(lv, today, over="symbol").select("symbol", "date", F.round("vol_proxy", 4).alias("vol_proxy"))


@query(_INDEX + f" SELECT p.date, p.symbol, {r('kospi_pct')} kospi_pct, {r('v_kosdaq', 4)} v_kosdaq FROM prep p JOIN idx ON idx.date=p.date")
def p21_attach_index(spark, sf_dir):
    p = prepared(spark, sf_dir)
    out = P.attach_index(p, P.index_by_date(p))
    return out.select("date", "symbol", F.round("kospi_pct", 6).alias("kospi_pct"), F.round("v_kosdaq", 4).alias("v_kosdaq"))


@query(_EVENTS + " SELECT date, symbol, coalesce(floor(close*scale+0.5e0) <> floor(close_raw+0.5e0), false) adjusted, true AS known FROM adj")
def p22_price_basis(spark, sf_dir):
    return P.price_basis(P.back_adjust(events(spark, sf_dir)))


_DEGRADED = "CASE WHEN (CAST(symbol AS INT)+day(date))%17=0 THEN NULL WHEN (CAST(symbol AS INT)+day(date))%19=0 THEN high+1 ELSE close END"


@query(
    PREP
    + f""", s AS (SELECT * REPLACE (CAST({_DEGRADED} AS DOUBLE) AS close) FROM price_history), g AS (SELECT date, count(*) n_rows, count(*) FILTER (WHERE close IS NULL OR close<=0 OR low>high OR NOT close BETWEEN low AND high OR volume<0) n_degraded FROM s GROUP BY date)
 SELECT *, {r('n_degraded/CAST(n_rows AS DOUBLE)')} AS share, CASE WHEN n_degraded/CAST(n_rows AS DOUBLE) <= 0.05e0 THEN 'COMPLETE' ELSE 'PARTIAL' END verdict FROM g"""
)
def p24_coverage_verdict(spark, sf_dir):
    return rounded(P.coverage_verdict(fixtures.price_history(spark, sf_dir).withColumn("close", F.expr(_DEGRADED))))


@query(PREP + f" SELECT date, symbol, s.close FROM (SELECT * REPLACE (CAST({_DEGRADED} AS DOUBLE) AS close) FROM price_history) s WHERE close IS NOT NULL AND (close<=0 OR low>high OR NOT close BETWEEN low AND high OR volume<0)")
def p23_price_anomalies(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir).withColumn("close", F.expr(_DEGRADED))
    return p.where(P.price_anomaly()).select("date", "symbol", "close")


_FINALS = """SELECT symbol, CASE WHEN CAST(symbol AS INT)%11=0 THEN '000000' ELSE symbol END AS code, CASE WHEN CAST(symbol AS INT)%7=0 THEN 152900 ELSE 153100 END AS hms, close, CASE WHEN CAST(symbol AS INT)%9=0 THEN close+1 ELSE close END AS close_again,
 CASE WHEN CAST(symbol AS INT)%8=0 THEN volume-1 ELSE volume END AS volume, CASE WHEN CAST(symbol AS INT)%5=0 THEN close/prev_close-1+0.02e0 ELSE close/prev_close-1 END AS rate FROM {p}"""
_LAST_DAY = "SELECT symbol, max(date) AS date, max_by(close, date) AS close, max_by(prev_close, date) AS prev_close, max_by(volume, date) AS volume FROM {p} GROUP BY symbol"


@query(
    PREP
    + f""", d AS ({_LAST_DAY.format(p='price_history')}), f AS ({_FINALS.format(p='d')}),
 j AS (SELECT d.*, f.code, f.hms, f.close AS final, f.close_again, f.volume AS fv, f.rate FROM d LEFT JOIN f ON f.symbol=d.symbol),
 z AS (SELECT *, CASE WHEN final IS NULL THEN 'no_final' WHEN code<>symbol THEN 'code' WHEN hms<153000 THEN 'clock' WHEN final<>close_again THEN 'two_prices' WHEN final<=0 THEN 'price' WHEN fv<volume THEN 'volume' WHEN abs(final/prev_close-1-rate)>0.005e0 THEN 'rate' END reason FROM j)
 SELECT date, symbol, close, reason, CASE WHEN reason IS NULL THEN final END close_final FROM z"""
)
def p25_confirm_close(spark, sf_dir):
    d = spark.sql(_LAST_DAY, p=fixtures.price_history(spark, sf_dir))
    return P.confirm_close(d, spark.sql(_FINALS, p=d)).select("date", "symbol", "close", "reason", "close_final")


@query(
    PREP
    + " SELECT date, symbol, turn, row_number() OVER (PARTITION BY date ORDER BY turn, symbol) AS place FROM (SELECT *, CASE WHEN chg_ratio > 0.1e0 THEN 0 WHEN chg_ratio > 0 THEN 1 ELSE 2 END AS turn FROM prep)"
)
def p26_pending_order(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn("selected", F.coalesce(F.col("chg_ratio") > 0.1, F.lit(False))).withColumn("admitted", F.coalesce(F.col("chg_ratio") > 0, F.lit(False)))
    return P.pending_order(p).select("date", "symbol", "turn", "place")


@query(PREP + " SELECT p.date, p.symbol, CASE WHEN c.prev_date IS NULL THEN 'no_previous_session' WHEN l.symbol IS NULL THEN 'not_listed_before' END reason FROM price_history p JOIN cal c ON c.date=p.date LEFT JOIN price_history l ON l.date=c.prev_date AND l.symbol=p.symbol")
def p27_eligible_listings(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return P.eligible_listings(p.select("date", "symbol"), p, C.sessions(p)).select("date", "symbol", "reason")


@query(
    PREP
    + " SELECT count(*) n_rows, min(date) first_date, max(date) last_date, count(DISTINCT symbol) n_symbols, CASE WHEN count(*) < (SELECT count(*) FROM price_history WHERE date < DATE '2025-06-01') THEN 'SHRUNK' WHEN max(date) < (SELECT max(date) FROM price_history WHERE date < DATE '2025-06-01') THEN 'STALE' WHEN min(date) <> (SELECT min(date) FROM price_history WHERE date < DATE '2025-06-01') THEN 'HEAD_MOVED' ELSE 'OK' END verdict FROM price_history"
)
def p28_fingerprint(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return P.compare_fingerprints(P.fingerprint(p.where("date < date'2025-06-01'")), P.fingerprint(p)).select("n_rows", "first_date", "last_date", "n_symbols", "verdict")


@query(PREP + " SELECT date, pos, prev_date, next_date FROM cal")
def c1_sessions(spark, sf_dir):
    return calendar(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query(PREP + " SELECT asked, (SELECT max(date) FROM cal WHERE cal.date < asked AND cal.date >= asked - 10) AS prev_session FROM (SELECT DISTINCT CAST(date + 1 AS DATE) AS asked FROM cal)")
def c2_previous_session(spark, sf_dir):
    cal = calendar(spark, sf_dir)
    return C.previous_session(cal.select(F.date_add("date", 1).alias("date")), cal)


@query(PREP + " SELECT max(date) AS last_date FROM price_history")
def c3_freshness(spark, sf_dir):
    return C.assert_fresh(fixtures.price_history(spark, sf_dir), "2019-01-02").agg(F.max("date").alias("last_date"))


_KNOTS = "SELECT date, symbol, inst_netbuy FROM {p} WHERE day(date)%4=0"


@query(PREP + f", k AS ({_KNOTS.format(p='price_history')}) SELECT p.date, p.symbol, k.inst_netbuy AS inst_netbuy_asof, k.date AS asof_date FROM price_history p ASOF LEFT JOIN k ON k.symbol=p.symbol AND k.date < p.date")
def c4_asof_strict(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return C.asof_join(p.select("date", "symbol"), spark.sql(_KNOTS, p=p), ["inst_netbuy"])


@query(PREP + f", k AS ({_KNOTS.format(p='price_history')}) SELECT p.date, p.symbol, k.inst_netbuy AS inst_netbuy_asof, k.date AS asof_date FROM price_history p ASOF LEFT JOIN k ON k.symbol=p.symbol AND k.date <= p.date")
def c5_asof_inclusive(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return C.asof_join(p.select("date", "symbol"), spark.sql(_KNOTS, p=p), ["inst_netbuy"], inclusive=True)


@query(PREP + " SELECT p.date, p.symbol, c.next_date, n.open AS next_open FROM price_history p JOIN cal c ON c.date=p.date LEFT JOIN price_history n ON n.date=c.next_date AND n.symbol=p.symbol")
def c6_next_session(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return C.next_session_join(p.select("date", "symbol"), p, C.sessions(p), ["open"]).select("date", "symbol", "next_date", "next_open")


@query(PREP + " SELECT date, symbol, lead(date) OVER w next_date, lead(open) OVER w next_open, lead(close) OVER w next_close FROM price_history WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def c7_next_row(spark, sf_dir):
    return C.next_row(fixtures.price_history(spark, sf_dir)).select("date", "symbol", "next_date", "next_open", "next_close")


@query(PREP + f", m AS (SELECT date, quantile_cont(chg_ratio, 0.5) a, quantile_cont(volume, 0.5) b FROM prep GROUP BY date) SELECT date, {r('lag(a) OVER (ORDER BY date)')} chg_ratio_lag1, {r('lag(b) OVER (ORDER BY date)')} volume_lag1 FROM m")
def c8_lagged_medians(spark, sf_dir):
    return rounded(C.lagged_index(prepared(spark, sf_dir), ["chg_ratio", "volume"]))


@query(PREP + " SELECT symbol, max(date) AS date, max_by(close, date) AS close, max_by(volume, date) AS volume FROM price_history GROUP BY symbol")
def c9_latest_by_symbol(spark, sf_dir):
    return C.latest_by_symbol(fixtures.price_history(spark, sf_dir), ["close", "volume"])


@query(PREP + " SELECT symbol, count(*) n_rows, max(date) last_date FROM (SELECT symbol, date FROM price_history WHERE date < DATE '2024-03-04' UNION ALL SELECT symbol, DATE '2024-03-04' FROM price_history WHERE date >= DATE '2024-03-04' GROUP BY symbol) GROUP BY symbol")
def c10_live_stitch(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    today = p.where("date >= date'2024-03-04'").groupBy("symbol").agg(F.min("open").alias("open")).withColumn("date", lit_date("2024-03-04"))
    return C.live_stitch(p, today, "2024-03-04").groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max("date").alias("last_date"))


_CLASSES = "SELECT cal.date, lpad(CAST(s.s_suppkey AS {text}),6,'0') AS symbol, s.s_acctbal > 0 AS is_screenable FROM {cal} cal CROSS JOIN {supplier} s WHERE cal.pos >= 200 AND s.s_suppkey % 10 <> 9"
_CLASSED = PREP + ", classes AS (" + _CLASSES.format(text="VARCHAR", cal="cal", supplier="supplier") + ")"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CLASSES.format(text="STRING", cal="{cal}", supplier="{supplier}"), cal=calendar(spark, sf_dir), supplier=fixtures.base(spark, sf_dir, "supplier"))


@query(
    _CLASSED
    + """ SELECT p.date, p.symbol, CASE WHEN coalesce(c.prev_date >= (SELECT min(date) FROM classes), false) THEN coalesce(k.is_screenable, false) ELSE right(p.symbol,1)='0' END is_screenable,
 CASE WHEN coalesce(c.prev_date >= (SELECT min(date) FROM classes), false) THEN 'classified' ELSE 'proxy' END AS source FROM price_history p JOIN cal c ON c.date=p.date LEFT JOIN classes k ON k.date=c.prev_date AND k.symbol=p.symbol"""
)
def c11_class_verdict(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    return C.class_verdict(p.select("date", "symbol"), classes(spark, sf_dir), C.sessions(p))


@query(
    _CLASSED
    + """, m AS (SELECT is_screenable s, right(symbol,1)='0' x FROM classes) SELECT CASE WHEN grouping(s)=1 THEN 'all' ELSE CAST(s AS VARCHAR) END AS scope, count(*) n, count(*) FILTER (WHERE x=s) n_agree, count(*) FILTER (WHERE x AND NOT s) n_false_pass, count(*) FILTER (WHERE NOT x AND s) n_false_drop FROM m GROUP BY GROUPING SETS ((s), ())"""
)
def c12_proxy_agreement(spark, sf_dir):
    return C.proxy_agreement(classes(spark, sf_dir))


@query(_CLASSED + " SELECT date FROM cal WHERE date BETWEEN (SELECT min(date) FROM classes) AND (SELECT max(date) FROM classes) AND pos % 37 = 0")
def c13_class_gaps(spark, sf_dir):
    cal = calendar(spark, sf_dir)
    holes = classes(spark, sf_dir).join(F.broadcast(cal.where("pos % 37 = 0").select("date")), "date", "left_anti")
    return C.class_gaps(holes, cal)


_RUNS = "SELECT event_type AS job, event_id AS run_id, ts AS completed_at, CASE event_id%4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAILED' ELSE 'RUNNING' END AS status, user_id FROM {events}"


@query(f"WITH runs AS ({_RUNS.format(events='events')}) SELECT job, user_id, max(completed_at) completed_at, max_by(run_id, (completed_at, run_id)) run_id FROM runs WHERE status IN ('COMPLETE','PARTIAL') AND completed_at <= TIMESTAMP '2024-01-20 15:20:00' GROUP BY 1,2")
def c14_read_as_of(spark, sf_dir):
    runs = spark.sql(_RUNS, events=fixtures.base(spark, sf_dir, "events"))
    return C.read_as_of(runs, "2024-01-20 15:20:00", ["job", "user_id"]).select("job", "user_id", "completed_at", "run_id")


@query(
    PREP
    + """, d AS (SELECT DISTINCT CAST(CAST(ts AS DATE) + INTERVAL 600 DAY AS DATE) AS date FROM events UNION SELECT DISTINCT CAST(CAST(ts AS DATE) + INTERVAL 700 DAY AS DATE) FROM events), o AS (SELECT date, 'half' AS kind FROM d WHERE day(date)=10)
 SELECT d.date, coalesce(o.kind, CASE WHEN c.date IS NOT NULL THEN 'open' END, CASE WHEN d.date <= (SELECT max(date) FROM cal) THEN 'closed' END, CASE WHEN isodow(d.date) IN (6,7) THEN 'closed' ELSE 'open' END) AS kind FROM d LEFT JOIN o ON o.date=d.date LEFT JOIN cal c ON c.date=d.date"""
)
def c15_session_kind(spark, sf_dir):
    e = fixtures.base(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    days = e.select(F.date_add("d", 600).alias("date")).union(e.select(F.date_add("d", 700))).distinct()
    return C.session_kind(days, days.where("day(date)=10").withColumn("kind", F.lit("half")), calendar(spark, sf_dir))


@query(
    PREP
    + """, u AS (SELECT date, symbol FROM prep WHERE chg_ratio > 0.05e0), t AS (SELECT u.date AS day, 'evening' AS session, symbol FROM u UNION ALL SELECT c.next_date, 'premarket', symbol FROM u JOIN cal c ON c.date=u.date WHERE c.next_date IS NOT NULL)
 SELECT day, session, count(DISTINCT symbol) n_symbols, min(symbol) first_symbol FROM t GROUP BY 1,2"""
)
def c16_offset_tasks(spark, sf_dir):
    return C.offset_tasks(prepared(spark, sf_dir).where("chg_ratio > 0.05").select("date", "symbol"), calendar(spark, sf_dir))


@query(
    PREP
    + """, cohort AS (SELECT c.date, lpad(CAST(s.s_suppkey AS VARCHAR),6,'0') AS symbol FROM cal c CROSS JOIN supplier s WHERE s.s_suppkey % 7 = 3 AND c.pos % 5 = 0)
 SELECT k.date, k.symbol, CASE WHEN p.close IS NULL THEN 'no_price' WHEN p.volume<=0 THEN 'not_traded' END reason, p.close IS NOT NULL AND NOT coalesce(p.volume<=0,false) AS member FROM cohort k LEFT JOIN price_history p ON p.date=k.date AND p.symbol=k.symbol"""
)
def c17_cohort_split(spark, sf_dir):
    cal = calendar(spark, sf_dir).where("pos % 5 = 0")
    names = fixtures.base(spark, sf_dir, "supplier").where("s_suppkey % 7 = 3").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"))
    cohort = names.crossJoin(F.broadcast(cal.select("date")))
    return C.cohort_split(cohort, fixtures.price_history(spark, sf_dir)).select("date", "symbol", "reason", "member")


@query(PREP + f" SELECT date, symbol, market, close_raw, {tick('close_raw', 'market', 'date')} AS tick, {r(tick_bp('close_raw', 'market', 'date'))} tick_bp FROM price_history")
def l1_tick_size(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    at = F.col("close_raw"), F.col("market"), F.col("date")
    return rounded(p.select("date", "symbol", "market", "close_raw", M.tick_size(*at).alias("tick"), M.tick_cost_bp(*at).alias("tick_bp")))


@query(PREP + f" SELECT date, {tax('date')} AS tax_bp FROM cal")
def l2_tax(spark, sf_dir):
    return calendar(spark, sf_dir).select("date", M.tax_bp(F.col("date")).alias("tax_bp"))


@query(PREP + f" SELECT date, symbol, {r(tax('date') + ' + 2*tick_cost_bp + 0.72792e0')} aa_bp, {r(tax('date') + ' + tick_cost_bp + 0.72792e0')} pa_bp FROM prep")
def l3_round_trip_cost(spark, sf_dir):
    p = fixtures.price_history(spark, sf_dir)
    at = F.col("close_raw"), F.col("market"), F.col("date")
    return rounded(p.select("date", "symbol", M.round_trip_bp(*at, ticks=2).alias("aa_bp"), M.round_trip_bp(*at, ticks=1).alias("pa_bp")))


