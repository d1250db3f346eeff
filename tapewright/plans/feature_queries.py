"""Queries of features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions.windows import numbered, text_draw, trailing
from tapewright.operators import features as X
from tapewright.operators import panel as P
from tapewright.plans import fixtures
from tapewright.plans.oracle import PREP, lit_date, query, r, rounded, text_draw_sql, tick_bp
from tapewright.plans.panel_queries import _INDEX, prepared


def pct(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {c} IS NOT NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c})-1)/2.0e0) / count({c}) OVER (PARTITION BY {by}) END"


_F1 = PREP + f""", f1 AS (SELECT *, (close-open)/greatest(high-low,1) f_body, (high-greatest(open,close))/greatest(high-low,1) f_upper, (high-low)/close f_range, ln(1+greatest(tv_clean,0)) f_log_tv, ln(1+greatest(mc_clean,0)) f_log_mc, {pct('tv_clean')} f_rank_tv, {pct('chg_ratio')} f_rank_chg FROM prep)"""
_F1_NAMES = ("f_body", "f_upper", "f_range", "f_log_tv", "f_log_mc", "f_rank_tv", "f_rank_chg")


def cols(names, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} {n}" for n in names)


@query(_F1.replace("ln(1+greatest(mc_clean,0))", "CASE WHEN mc_clean IS NOT NULL THEN ln(1+greatest(mc_clean,0)) END") + f" SELECT date, symbol, {cols(_F1_NAMES)} FROM f1")
def f1_cross_section(spark, sf_dir):
    return rounded(X.cross_section(prepared(spark, sf_dir)).select("date", "symbol", *_F1_NAMES))


def roll(c: str, n: int, f: str, least: int, lag: int = 1, extra: str = "") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n + lag - 1} PRECEDING AND {str(lag) + ' PRECEDING' if lag else 'CURRENT ROW'})"
    return f"CASE WHEN count({c}) {w} >= {least} THEN {f}({c}) {w} END"


_WIN = "PARTITION BY symbol ORDER BY date"
_F2 = (
    PREP
    + f""", h0 AS (SELECT *, ln(1+chg_ratio) lr, CASE WHEN open>0 AND prev_close>0 THEN open/prev_close-1 END gap, coalesce(chg_ratio>=0.05e0,false) up_ FROM prep),
 h1 AS (SELECT *, CASE WHEN lr IS NOT NULL THEN sum(lr) OVER ({_WIN} ROWS UNBOUNDED PRECEDING) END idx, CASE WHEN chg_ratio>=0.05e0 THEN lead(gap) OVER ({_WIN}) END au, CASE WHEN open>0 THEN close/open-1 END idr FROM h0),
 h2 AS (SELECT *, exp(idx)*volume amt, row_number() OVER ({_WIN}) rn FROM h1),
 h3 AS (SELECT date, symbol, {roll('lr',5,'sum',3)} f_ret5, {roll('lr',20,'sum',10)} f_ret20, {roll('lr',60,'sum',30)} f_ret60, exp(idx-({roll('idx',60,'max',20,0)}))-1 f_dist_high60,
  CASE WHEN rn>=10 THEN CAST(sum(CASE WHEN up_ THEN 1 ELSE 0 END) OVER ({_WIN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS DOUBLE) END f_upcount20, {roll('gap',20,'avg',10)} f_on_mean20, {roll('gap',60,'avg',30)} f_on_mean60, gap f_gap, {roll('au',60,'avg',3)} f_upnext_on60, {roll('idr',20,'avg',10)} f_id_mean20,
  {roll('inst_netbuy',5,'sum',3)} i5, {roll('foreign_netbuy',5,'sum',3)} f5, nullif({roll('amt',5,'sum',3)},0) den FROM h2),
 f2 AS (SELECT *, CASE WHEN i5/den IS NOT NULL THEN least(greatest(i5/den,-1),1) END f_inst_cum5, CASE WHEN f5/den IS NOT NULL THEN least(greatest(f5/den,-1),1) END f_foreign_cum5 FROM h3)"""
)
_F2_NAMES = ("f_ret5", "f_ret20", "f_ret60", "f_dist_high60", "f_upcount20", "f_on_mean20", "f_on_mean60", "f_gap", "f_upnext_on60", "f_id_mean20", "f_inst_cum5", "f_foreign_cum5")


@query(_F2 + f" SELECT date, symbol, {cols(_F2_NAMES)} FROM f2")
def f2_history(spark, sf_dir):
    return rounded(X.history(prepared(spark, sf_dir)).select("date", "symbol", *_F2_NAMES))


@query(_F2 + f" SELECT date, symbol, {cols(('f_ret20', 'f_on_mean60'))} FROM f2 WHERE CAST(symbol AS INT)%10=4 AND day(date)=15")
def f3_restricted(spark, sf_dir):
    p = prepared(spark, sf_dir)
    keys = p.where("CAST(symbol AS INT)%10=4 AND day(date)=15").select("date", "symbol")
    return rounded(X.restricted(p, keys).select("date", "symbol", "f_ret20", "f_on_mean60"))


@query(PREP + f", l AS (SELECT date, symbol, lag(inst_netbuy) OVER ({_WIN}) fl, lag(tv_clean) OVER ({_WIN}) am FROM prep) SELECT date, symbol, {r('least(greatest(coalesce(fl,0)/greatest(coalesce(am,1),1),-1),1)')} f_flow_density, {r(pct('fl'))} f_flow_rank FROM l")
def f4_lagged_flow_density(spark, sf_dir):
    return rounded(X.lagged_flow_density(prepared(spark, sf_dir)).select("date", "symbol", "f_flow_density", "f_flow_rank"))


@query(PREP + f" SELECT date, symbol, {r('tick_cost_bp')} f_tick_cost, {r('CASE WHEN close_raw>0 THEN ln(close_raw) END')} f_log_price FROM prep")
def f5_cost_features(spark, sf_dir):
    return rounded(X.cost_features(prepared(spark, sf_dir)).select("date", "symbol", "f_tick_cost", "f_log_price"))


_F6_NAMES = ("t_ret5", "t_ret20", "t_ret60", "t_ma5", "t_ma20", "t_ma60", "t_vol20", "t_vol60", "t_atr14", "t_high252", "t_low252", "t_volume_ratio", "t_amihud20", "t_flow_z", "t_up_ratio", "t_gap_mean")
_F6 = (
    PREP
    + f""", t0 AS (SELECT *, lag(close) OVER ({_WIN}) pc FROM prep), t1 AS (SELECT *, close/pc-1 rr, open/pc-1 gap, greatest(high-low, abs(high-pc), abs(low-pc)) tr FROM t0), t2 AS (SELECT *, abs(rr)/nullif(tv_clean,0) il, CASE WHEN rr>0 THEN 1.0e0 ELSE 0.0e0 END ud FROM t1),
 t3 AS (SELECT date, symbol, close/lag(close,5) OVER ({_WIN})-1 t_ret5, close/lag(close,20) OVER ({_WIN})-1 t_ret20, close/lag(close,60) OVER ({_WIN})-1 t_ret60, close/({roll('close',5,'avg',3,0)})-1 t_ma5, close/({roll('close',20,'avg',10,0)})-1 t_ma20, close/({roll('close',60,'avg',30,0)})-1 t_ma60,
  {roll('rr',20,'stddev',10,0)} t_vol20, {roll('rr',60,'stddev',30,0)} t_vol60, ({roll('tr',14,'avg',7,0)})/close t_atr14, close/({roll('high',252,'max',60,0)})-1 t_high252, close/({roll('low',252,'min',60,0)})-1 t_low252, volume/nullif({roll('volume',20,'avg',10,0)},0) t_volume_ratio, {roll('il',20,'avg',10,0)} t_amihud20,
  (inst_netbuy-({roll('inst_netbuy',20,'avg',10,0)}))/nullif({roll('inst_netbuy',20,'stddev',10,0)},0) fz, {roll('ud',20,'avg',10,0)} t_up_ratio, {roll('gap',20,'avg',10,0)} t_gap_mean FROM t2),
 f6 AS (SELECT *, CASE WHEN fz IS NOT NULL THEN least(greatest(fz,-5),5) END t_flow_z FROM t3)"""
)


@query(_F6 + f" SELECT date, symbol, {cols(_F6_NAMES)} FROM f6")
def f6_trailing(spark, sf_dir):
    return rounded(X.trailing_features(prepared(spark, sf_dir)).select("date", "symbol", *_F6_NAMES))


@query(_F6 + f" SELECT date, symbol, {r('lag(t_ret20) OVER w')} t_ret20_asof, {r('CASE WHEN lag(t_vol20) OVER w IS NULL THEN 0.03e0 ELSE greatest(lag(t_vol20) OVER w, 0.005e0) END')} vol_used FROM f6 WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def f7_attach_trailing(spark, sf_dir):
    p = prepared(spark, sf_dir)
    out = X.attach_trailing(p.select("date", "symbol"), X.trailing_features(p), ["t_ret20", "t_vol20"])
    return rounded(out.select("date", "symbol", "t_ret20_asof", "vol_used"))


@query(PREP + f", c0 AS (SELECT *, abs(chg_ratio)/greatest(tv_clean,1e-6) i, tv_clean/nullif(mc_clean,0) t FROM prep) SELECT date, symbol, {r(roll('i',20,'avg',10))} h_amihud20, {r('1e4*('+roll('t',20,'avg',10)+')+1.3e-7', 6)} h_turnover20_bp FROM c0")
def f8_core_history(spark, sf_dir):
    out = X.core_history(prepared(spark, sf_dir))
    return out.select("date", "symbol", F.round("h_amihud20", 6).alias("h_amihud20"), F.round(F.col("h_turnover20") * 1e4 + 1.3e-7, 6).alias("h_turnover20_bp"))


_F9_NAMES = ("e_vol20", "e_max20", "e_min20", "e_range20", "e_program5", "e_tv_growth")


@query(
    PREP
    + f", e0 AS (SELECT *, (high-low)/nullif(close,0) rng, program_netbuy/nullif(volume,0) pd FROM prep), e1 AS (SELECT date, symbol, {roll('chg_ratio',20,'stddev',10)} e_vol20, {roll('chg_ratio',20,'max',10)} e_max20, {roll('chg_ratio',20,'min',10)} e_min20, {roll('rng',20,'avg',10)} e_range20, {roll('pd',5,'avg',3)} e_program5, ln(1+({roll('tv_clean',5,'avg',3)}))-ln(1+({roll('tv_clean',60,'avg',30)})) e_tv_growth FROM e0) SELECT date, symbol, {cols(_F9_NAMES)} FROM e1"
)
def f9_extended_history(spark, sf_dir):
    return rounded(X.extended_history(prepared(spark, sf_dir)).select("date", "symbol", *_F9_NAMES))


@query(PREP + f" SELECT date, {r('avg(CASE WHEN chg_ratio>0 THEN 1.0 WHEN chg_ratio IS NOT NULL THEN 0.0 END)')} m_breadth, {r('sum(chg_ratio*mc_clean)/nullif(sum(CASE WHEN chg_ratio IS NOT NULL THEN mc_clean END),0)')} m_cap_chg, {r('avg(chg_ratio)')} m_equal_chg, {r('stddev(chg_ratio)')} m_dispersion FROM prep GROUP BY date")
def f10_market_state(spark, sf_dir):
    return rounded(X.market_state(prepared(spark, sf_dir)))


@query(
    _INDEX
    + f", z AS (SELECT *, count(kospi_level) OVER a n20, avg(kospi_level) OVER a m20, count(kospi_pct) OVER b n60, avg(kospi_pct) OVER b m60, nullif(stddev(kospi_pct) OVER b,0) s60, lag(date) OVER (ORDER BY date) pd FROM idx WINDOW a AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT date, {r('kospi_pct-kosdaq_pct')} i_diff, {r('CASE WHEN n20>=10 THEN kospi_level/m20-1 END')} i_ma20, {r('CASE WHEN n60>=30 THEN (kospi_pct-m60)/s60 END', 4)} i_z60, CAST(date-pd AS INT) i_gap_days, CAST(isodow(date)-1 AS INT) i_weekday, isodow(date)=4 AND day(date) BETWEEN 8 AND 14 AS i_expiry FROM z"
)
def f11_index_features(spark, sf_dir):
    out = X.index_features(P.index_by_date(prepared(spark, sf_dir)))
    return out.select("date", F.round("i_diff", 6).alias("i_diff"), F.round("i_ma20", 6).alias("i_ma20"), F.round("i_z60", 4).alias("i_z60"), "i_gap_days", "i_weekday", "i_expiry")


_F12_NAMES = (
    "buy_price_change_rate", "gap_ratio", "intraday_return", "intraday_range", "close_position", "upper_shadow_ratio", "body_ratio", "turnover", "inst_density", "foreign_density", "major_density", "prog_dominance", "rank_ratio", "relative_change_kospi", "relative_change_kosdaq",
    "sector_relative_change", "relative_change_rate", "v_kospi", "v_kospi_change", "v_kosdaq", "v_kosdaq_change", *(f"log_{n}" for n in X.LOGGED), *X.SIGNED_LOG, *X.RANKED.values(), "candle_strength", "range_efficiency", "flow_turnover", "relative_flow_strength", *X.WEEKDAYS, "flow_consensus",
    "flow_alignment_direction", "friday_selection_rank_pct",
)


def snapshots(spark, sf_dir):
    """The prepared panel as snapshots: the decision price is the close, the rank is by traded value, a sector is the symbol modulo 7."""
    p = prepared(spark, sf_dir)
    index = P.index_by_date(p).select("date", (F.col("kospi_pct") * 100).alias("kospi_change"), (F.col("kosdaq_pct") * 100).alias("kosdaq_change"), "v_kospi", "v_kosdaq")
    by_value = W.partitionBy("date").orderBy(F.col("tv_clean").desc(), "symbol")
    return p.join(index, "date").select(
        F.col("date").alias("trade_date"), F.col("symbol").alias("stock_code"), F.col("market").alias("market_type"), (F.col("symbol").cast("int") % 7).alias("theme_sector"), F.col("open").alias("open_price"), F.col("high").alias("high_price"), F.col("low").alias("low_price"),
        F.col("close").alias("close_price"), F.col("prev_close").alias("prev_close_price"), F.col("close").alias("buy_price"), (F.col("chg_ratio") * 100).alias("change_rate"), F.col("tv_clean").alias("trade_value_100m"), "market_cap_100m", F.col("volume").cast("double").alias("volume"),
        trailing(F.col("tv_clean"), 20, F.avg, 10).alias("avg_trade_value"), F.col("inst_netbuy").cast("double").alias("inst_net_buy"), F.col("foreign_netbuy").cast("double").alias("foreign_net_buy"), F.col("program_netbuy").cast("double").alias("prog_net_buy"),
        F.row_number().over(by_value).alias("selection_rank"), F.when(F.dayofmonth("date") % 5 != 0, F.count("*").over(W.partitionBy("date"))).alias("total_candidate_count"), "kospi_change", "kosdaq_change", "v_kospi", "v_kosdaq",
    )


def _clipped(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}e0), {high}e0) END"


_VOL = "coalesce(last_value({v} IGNORE NULLS) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), first_value({v} IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_F12 = (
    _INDEX
    + f""", n0 AS (SELECT p.date AS trade_date, p.symbol AS stock_code, p.market AS market_type, CAST(p.symbol AS INT)%7 AS theme_sector, open AS o, high AS h, low AS l, close AS c, nullif(prev_close,0) AS pc, chg_ratio*100 AS change_rate, CAST(tv_clean AS DOUBLE) AS tv, market_cap_100m AS mc, CAST(volume AS DOUBLE) AS volume,
   {roll('tv_clean', 20, 'avg', 10)} AS atv, CAST(inst_netbuy AS DOUBLE) AS ib, CAST(foreign_netbuy AS DOUBLE) AS fb, CAST(program_netbuy AS DOUBLE) AS pb, row_number() OVER (PARTITION BY p.date ORDER BY tv_clean DESC NULLS LAST, symbol) AS sr, CASE WHEN day(p.date)%5<>0 THEN count(*) OVER (PARTITION BY p.date) END AS tc,
   kospi_pct*100 AS kc, kosdaq_pct*100 AS qc FROM (SELECT prep.*, kospi_pct, kosdaq_pct FROM prep JOIN idx ON idx.date=prep.date) p),
 v0 AS (SELECT date AS trade_date, nullif(v_kospi,0) AS a, nullif(v_kosdaq,0) AS b FROM idx), v1 AS (SELECT trade_date, {_VOL.format(v='a')} AS v_kospi, {_VOL.format(v='b')} AS v_kosdaq FROM v0),
 v2 AS (SELECT *, coalesce(v_kospi/lag(v_kospi) OVER (ORDER BY trade_date)-1,0) AS v_kospi_change, coalesce(v_kosdaq/lag(v_kosdaq) OVER (ORDER BY trade_date)-1,0) AS v_kosdaq_change FROM v1),
 n1 AS (SELECT *, CASE WHEN h-l IS NOT NULL THEN greatest(h-l,1) END AS span, nullif(tv,0) AS nv FROM n0),
 n2 AS (SELECT n1.*, (c-pc)/pc*100 AS buy_price_change_rate, (o-pc)/pc*100 AS gap_ratio, (c-o)/nullif(o,0) AS intraday_return, (h-l)/pc*100 AS intraday_range, (c-l)/span AS close_position, (h-greatest(o,c))/span AS upper_shadow_ratio, abs(c-o)/span AS body_ratio, tv/CASE WHEN mc IS NOT NULL THEN greatest(mc,0.01e0) END AS turnover,
   coalesce(ib,0)/nv AS inst_density, coalesce(fb,0)/nv AS foreign_density, (coalesce(ib,0)+coalesce(fb,0))/nv AS major_density, pb/nv AS prog_dominance, sr/CAST(greatest(coalesce(tc,1),1) AS DOUBLE) AS rank_ratio, change_rate-kc AS relative_change_kospi, change_rate-qc AS relative_change_kosdaq,
   change_rate-avg(change_rate) OVER (PARTITION BY trade_date, theme_sector) AS sector_relative_change FROM n1),
 n3 AS (SELECT n2.*, v_kospi, v_kospi_change, v_kosdaq, v_kosdaq_change, buy_price_change_rate-CASE WHEN contains(upper(market_type),'KOSDAQ') THEN qc ELSE kc END AS relative_change_rate, CASE WHEN mc IS NOT NULL THEN ln(1+greatest(mc,0)) END AS log_market_cap_100m, CASE WHEN tv IS NOT NULL THEN ln(1+greatest(tv,0)) END AS log_trade_value_100m,
   CASE WHEN volume IS NOT NULL THEN ln(1+greatest(volume,0)) END AS log_volume, CASE WHEN atv IS NOT NULL THEN ln(1+greatest(atv,0)) END AS log_avg_trade_value, sign(ib)*ln(1+abs(ib)) AS inst_net_buy, sign(fb)*ln(1+abs(fb)) AS foreign_net_buy, sign(pb)*ln(1+abs(pb)) AS prog_net_buy,
   {pct('tv', 'n2.trade_date')} AS trade_value_pct_rank, {pct('ib', 'n2.trade_date')} AS inst_net_buy_pct_rank, {pct('fb', 'n2.trade_date')} AS foreign_net_buy_pct_rank, {pct('change_rate', 'n2.trade_date')} AS change_rate_pct_rank, {pct('major_density', 'n2.trade_date')} AS major_density_pct_rank, {pct('prog_dominance', 'n2.trade_date')} AS prog_dominance_pct_rank,
   {pct('gap_ratio', 'n2.trade_date')} AS gap_ratio_pct_rank, {pct('turnover', 'n2.trade_date')} AS turnover_pct_rank, coalesce(inst_density,0) AS x1, coalesce(foreign_density,0) AS x2, coalesce(prog_dominance,0) AS x3, isodow(n2.trade_date) AS dow FROM n2 JOIN v2 ON v2.trade_date=n2.trade_date),
 n4 AS (SELECT *, {_clipped('(2*close_position-1)*body_ratio*intraday_range', -5, 5)} AS candle_strength, {_clipped('abs(intraday_return)/CASE WHEN intraday_range IS NOT NULL THEN greatest(intraday_range/100,1e-6) END', 0, 5)} AS range_efficiency, {_clipped('major_density*turnover', 0, 5)} AS flow_turnover,
   {_clipped('major_density_pct_rank*change_rate_pct_rank', 0, 1)} AS relative_flow_strength, {', '.join(f'CASE WHEN dow={k + 1} THEN 1.0e0 ELSE 0.0e0 END AS {n}' for k, n in enumerate(X.WEEKDAYS))}, sign(x1)+sign(x2)+sign(x3) AS flow_consensus,
   CASE WHEN abs(x1)+abs(x2)+abs(x3)<>0 THEN (x1+x2+x3)/(abs(x1)+abs(x2)+abs(x3)) ELSE 0 END AS flow_alignment_direction, CASE WHEN dow=5 THEN 1-rank_ratio ELSE 0 END AS friday_selection_rank_pct FROM n3)"""
)


# Ratios of round numbers often lie right between two rounded ones: a billionth more decides them in both engines.
@query(_F12 + " SELECT trade_date, stock_code, " + ", ".join(f"{r(f'{n}+1e-9', 5)} {n}" for n in _F12_NAMES) + " FROM n4")
def f12_snapshot_block(spark, sf_dir):
    block = X.snapshot_block(snapshots(spark, sf_dir))
    return block.select("trade_date", "stock_code", *(F.round(F.col(n).cast("double") + 1e-9, 5).alias(n) for n in _F12_NAMES))


@query(PREP + f", a AS (SELECT date, symbol, chg_ratio-quantile_cont(chg_ratio,0.5) OVER (PARTITION BY date) d FROM prep), b AS (SELECT *, nullif(quantile_cont(abs(d),0.5) OVER (PARTITION BY date),0) mad FROM a) SELECT date, symbol, {r('CASE WHEN d/mad IS NOT NULL THEN least(greatest(d/mad,-5),5) END', 3)} chg_ratio_rz FROM b")
def f13_robust_z(spark, sf_dir):
    return X.robust_z(prepared(spark, sf_dir), "chg_ratio").select("date", "symbol", F.round("chg_ratio_rz", 3).alias("chg_ratio_rz"))


@query(
    PREP
    + f""", d AS (SELECT date, CASE WHEN day(date)%6=0 THEN 0 ELSE max(close) END v FROM prep GROUP BY date), e AS (SELECT date, nullif(v,0) v FROM d), f AS (SELECT date, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) v FROM e)
 SELECT date, v, {r('v/lag(v) OVER (ORDER BY date)-1')} v_chg FROM f"""
)
def f14_fill_by_date(spark, sf_dir):
    d = prepared(spark, sf_dir).groupBy("date").agg(F.max("close").alias("v")).withColumn("v", F.when(F.dayofmonth("date") % 6 == 0, F.lit(0.0)).otherwise(F.col("v")))
    return rounded(X.fill_by_date(d, "v"))


@query(
    PREP
    + f""", rr AS (SELECT date, symbol, ln(close/prev_close) r FROM prep WHERE date < DATE '2023-01-01' AND date >= DATE '2023-01-01' - 550 AND close>0 AND prev_close>0), g AS (SELECT a.symbol a, b.symbol b, count(*) n, corr(a.r,b.r) c FROM rr a JOIN rr b ON a.date=b.date AND a.symbol<b.symbol GROUP BY 1,2 HAVING count(*)>=15) SELECT a, b, n, {r('c', 4)} corr FROM g"""
)
def f15_pair_correlations(spark, sf_dir):
    return X.pair_correlations(prepared(spark, sf_dir), 2023, least=15).withColumn("corr", F.round("corr", 4))


@query()
def f15_sector_clusters(spark, sf_dir):
    return X.sector_clusters(prepared(spark, sf_dir), k=5, least=15)


def composites(spark, sf_dir):
    """A denser panel: the mean relative of the names of each of 20 groups, which has a value on most days."""
    p = prepared(spark, sf_dir).where("close > 0 and prev_close > 0")
    group = F.format_string("%02d", F.col("symbol").cast("int") % 20)
    return p.groupBy("date", group.alias("symbol")).agg(F.avg(F.col("close") / F.col("prev_close")).alias("close")).withColumn("prev_close", F.lit(1.0))


_COMPOSITE_DAYS = "SELECT date, symbol, ln(rel) r FROM comp WHERE date < DATE '2023-01-01' AND date >= DATE '2023-01-01' - 550"


@query(
    PREP
    + f""", comp AS (SELECT date, printf('%02d', CAST(symbol AS INT)%20) AS symbol, avg(close/prev_close) rel FROM prep WHERE close>0 AND prev_close>0 GROUP BY 1,2), rr AS ({_COMPOSITE_DAYS}), g AS (SELECT a.symbol a, b.symbol b, count(*) n, corr(a.r,b.r) c FROM rr a JOIN rr b ON a.date=b.date AND a.symbol<b.symbol GROUP BY 1,2 HAVING count(*)>=120) SELECT a, b, n, {r('c', 4)} corr FROM g"""
)
def f15_composite_correlations(spark, sf_dir):
    """At the full least number of 120 common dates."""
    return X.pair_correlations(composites(spark, sf_dir), 2023).withColumn("corr", F.round("corr", 4))


@query()
def f15_composite_clusters(spark, sf_dir):
    """Clusters of the groups, year by year, at the full least number of 120 returns."""
    return X.sector_clusters(composites(spark, sf_dir), k=5)


@query(
    PREP
    + f""", j AS (SELECT *, CAST(symbol AS INT)%7 AS cl FROM prep), g AS (SELECT date, cl, avg(chg_ratio) m, count(*) n, avg(CASE WHEN chg_ratio>0 THEN 1.0 WHEN chg_ratio IS NOT NULL THEN 0.0 END) b FROM j GROUP BY 1,2), h AS (SELECT *, CASE WHEN count(m) OVER w >= 3 THEN sum(m) OVER w END mom FROM g WINDOW w AS (PARTITION BY cl ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT j.date, j.symbol, h.n sec_n, {r('m')} sec_mean, {r('b')} sec_breadth, {r('mom')} sec_mom5, {r('chg_ratio-m')} sec_rel FROM j JOIN h ON h.date=j.date AND h.cl=j.cl"""
)
def f16_sector_aggregates(spark, sf_dir):
    p = prepared(spark, sf_dir)
    clusters = p.select("symbol", (F.col("symbol").cast("int") % 7).alias("cluster")).distinct()
    return rounded(X.sector_aggregates(p, clusters).select("date", "symbol", "sec_n", "sec_mean", "sec_breadth", "sec_mom5", "sec_rel"))


_LADDER = (
    PREP
    + f""", sa AS (SELECT *, lag(close) OVER ({_WIN}) c1, {roll('close',120,'avg',60,0)} m120, {roll('close',20,'avg',10,0)} m20, {roll('high',252,'max',60,0)} h252, {roll('volume',5,'avg',3,0)} w5, {roll('volume',20,'avg',10,0)} w20 FROM prep),
 sb AS (SELECT *, coalesce(c1 > 0 AND abs(close/c1-1) <= 0.31e0 AND close/c1-1 >= 0.29e0 AND close >= high, false) lim, coalesce(c1 <= lag(m120) OVER ({_WIN}) AND close > m120, false) cross120, close/nullif(m20,0)-1 d20, close/nullif(h252,0) hr, w5/nullif(w20,0) vr, (close-low)/nullif(high-low,0) cp FROM sa),
 sc AS (SELECT *, CASE WHEN lag(lim) OVER ({_WIN}) THEN '{X.SCENARIOS[0]}' WHEN cp >= 0.90e0 AND chg_ratio*100 >= 12 THEN '{X.SCENARIOS[1]}' WHEN cp <= 0.40e0 AND chg_ratio > 0 THEN '{X.SCENARIOS[2]}' WHEN hr >= 0.99e0 THEN '{X.SCENARIOS[3]}' WHEN hr >= 0.93e0 THEN '{X.SCENARIOS[4]}' WHEN cross120 THEN '{X.SCENARIOS[5]}'
   WHEN d20 >= 0.35e0 AND vr >= 2.3e0 THEN '{X.SCENARIOS[6]}' WHEN vr >= 1.6e0 THEN '{X.SCENARIOS[7]}' ELSE '{X.SCENARIOS[8]}' END scenario FROM sb)"""
)


@query(_LADDER + " SELECT date, symbol, scenario FROM sc")
def f17_scenarios(spark, sf_dir):
    return X.scenario_ladder(prepared(spark, sf_dir)).select("date", "symbol", "scenario")


@query(
    _LADDER
    + f""", t AS (SELECT scenario ours, CASE WHEN day(date)%10=0 THEN '{X.SCENARIOS[8]}' ELSE scenario END theirs FROM sc), a AS (SELECT theirs AS label, count(*) support, avg(CASE WHEN ours=theirs THEN 1.0 ELSE 0.0 END) recall FROM t GROUP BY 1), b AS (SELECT ours AS label, avg(CASE WHEN ours=theirs THEN 1.0 ELSE 0.0 END) prec FROM t GROUP BY 1)
 SELECT coalesce(a.label,b.label) AS label, coalesce(support,0) support, {r('recall')} recall, {r('prec')} AS precision FROM a FULL JOIN b ON a.label=b.label UNION ALL SELECT 'all', count(*), {r('avg(CASE WHEN ours=theirs THEN 1.0 ELSE 0.0 END)')}, {r('avg(CASE WHEN ours=theirs THEN 1.0 ELSE 0.0 END)')} FROM t"""
)
def f18_scenario_agreement(spark, sf_dir):
    s = X.scenario_ladder(prepared(spark, sf_dir)).withColumn("theirs", F.when(F.dayofmonth("date") % 10 == 0, X.SCENARIOS[8]).otherwise(F.col("scenario")))
    return rounded(X.scenario_agreement(s, "scenario", "theirs"))


@query(_LADDER + " SELECT date, symbol, " + ", ".join(f"CASE WHEN scenario='{s}' THEN 1 ELSE 0 END is_{c}" for s, c in zip(X.SCENARIOS, X.SCENARIO_COLUMNS, strict=True)) + ", CAST(1 AS BIGINT) n_scenarios FROM sc")
def f19_action_panel(spark, sf_dir):
    s = X.scenario_ladder(prepared(spark, sf_dir)).select("date", "symbol", "scenario")
    return X.action_panel(s.unionByName(s.where("day(date)=1")))


_DAY = "(SELECT max(date) FROM price_history WHERE date <= DATE '2024-05-20')"


@query(_F2.replace(", h0 AS (SELECT *", f", prep_cut AS (SELECT * FROM prep WHERE date <= {_DAY}), h0 AS (SELECT *").replace("up_ FROM prep)", "up_ FROM prep_cut)") + f" SELECT symbol, {cols(('f_ret20', 'f_gap', 'f_on_mean20'))} FROM f2 WHERE date = {_DAY}")
def f20_live_features(spark, sf_dir):
    p = prepared(spark, sf_dir)
    day = str(p.where("date <= date'2024-05-20'").agg(F.max("date")).first()[0])
    today = p.where(F.col("date") == lit_date(day))
    return rounded(X.live_features(p, today, day).select("symbol", "f_ret20", "f_gap", "f_on_mean20"))


_NOISY = "SELECT * REPLACE (CASE WHEN CAST(symbol AS INT)%5=0 THEN f_body*0.5e0 ELSE f_body END AS f_body) FROM f1"


_PARITY = (
    _F1
    + f""", y AS ({_NOISY}), j AS (SELECT f1.date, f1.symbol, 'f_body' AS feature, f1.f_body x, y.f_body y FROM f1 JOIN y ON y.date=f1.date AND y.symbol=f1.symbol UNION ALL SELECT f1.date, f1.symbol, 'f_range', f1.f_range, y.f_range FROM f1 JOIN y ON y.date=f1.date AND y.symbol=f1.symbol),
 k AS (SELECT * FROM j WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (SELECT *, {pct('x', 'date, feature')} rx, {pct('y', 'date, feature')} ry FROM k), d AS (SELECT feature, date, corr(rx,ry) rho, count(*) n FROM rk GROUP BY 1,2), s AS (SELECT feature, avg(CASE WHEN isnan(rho) THEN NULL ELSE rho END) sp FROM d WHERE n>=3 GROUP BY 1), m AS (SELECT feature, quantile_cont(abs(x-y),0.5) md, count(*) n FROM k GROUP BY 1),
 fp AS (SELECT m.feature, n, {r('md')} median_diff, {r('sp')} spearman, CASE WHEN sp>=0.95e0 THEN 'MATCH' WHEN sp>=0.8e0 THEN 'APPROXIMATE' ELSE 'MISMATCH' END verdict FROM m JOIN s ON s.feature=m.feature)"""
)


@query(_PARITY + " SELECT * FROM fp")
def f21_feature_parity(spark, sf_dir):
    a = X.cross_section(prepared(spark, sf_dir))
    b = a.withColumn("f_body", F.when(F.col("symbol").cast("int") % 5 == 0, F.col("f_body") * 0.5).otherwise(F.col("f_body")))
    return rounded(X.feature_parity(a, b, ["f_body", "f_range"]))


@query(_PARITY + ", fc(feature, unit, timing) AS (VALUES " + ", ".join(str(x) for x in X.FEATURE_CONTRACT) + ") SELECT fc.*, spearman, coalesce(verdict,'UNMEASURED') verdict FROM fc LEFT JOIN fp ON fp.feature=fc.feature")
def f22_feature_contract(spark, sf_dir):
    return X.feature_contract(spark, f21_feature_parity(spark, sf_dir))


_DRAWN = "p.date||':'||p.symbol||':3'"


@query(
    fixtures.sql("price_history", "bars_1m") + PREP[len(fixtures.sql("price_history")) :]
    + f""", im AS (SELECT snapshot_date, symbol, count(*) FILTER (WHERE minute<920) nc, arg_max(close,minute) FILTER (WHERE minute<920) c0, arg_max(close,minute) FILTER (WHERE minute>=920) c1 FROM bars_1m GROUP BY 1,2), mv AS (SELECT row_number() OVER (ORDER BY snapshot_date, symbol)-1 slot, (c1/c0-1)/100 AS mv FROM im WHERE nc>=10 AND c1/c0 IS NOT NULL), mn AS (SELECT count(*) n FROM mv),
 dr AS (SELECT p.* REPLACE (least(greatest(close/(1+mv),low),high) AS close, tv_clean*least(greatest(close/(1+mv),low),high)/close AS tv_clean, close_raw*least(greatest(close/(1+mv),low),high)/close AS close_raw) FROM prep p, mn JOIN mv ON mv.slot = {text_draw_sql(_DRAWN)} % mn.n),
 f1 AS (SELECT *, (close-open)/greatest(high-low,1) f_body, (high-greatest(open,close))/greatest(high-low,1) f_upper, (high-low)/close f_range, ln(1+greatest(tv_clean,0)) f_log_tv, CASE WHEN mc_clean IS NOT NULL THEN ln(1+greatest(mc_clean,0)) END f_log_mc, {pct('tv_clean')} f_rank_tv, {pct('chg_ratio')} f_rank_chg, {tick_bp('close_raw', 'market', 'date')} f_tick_cost FROM dr)
 SELECT date, symbol, {r('close', 4)} AS close, {cols(_F1_NAMES, 4)}, {r('f_tick_cost', 4)} f_tick_cost FROM f1"""
)
def f23_noise_perturbation(spark, sf_dir):
    from tapewright.operators.bars import auction_impact
    from tapewright.plans.bar_queries import bars

    moves = auction_impact(bars(spark, sf_dir)).where("impact_bp is not null").select((F.col("impact_bp") / 1e4 / 100).alias("move"), "snapshot_date", "symbol")
    moves = numbered(moves, "snapshot_date", "symbol", "slot").select("slot", "move")
    return rounded(X.noise_perturbation(prepared(spark, sf_dir), moves, draw=text_draw).select("date", "symbol", "close", *_F1_NAMES, "f_tick_cost"), 4)
