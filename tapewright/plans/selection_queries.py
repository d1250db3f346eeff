"""Queries of screens, selection, costs, labels, exits and evaluation."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import market as M
from tapewright.functions.windows import text_draw
from tapewright.operators import calendar as C
from tapewright.operators import evaluate as E
from tapewright.operators import panel as P
from tapewright.operators import universe as U
from tapewright.plans import fixtures
from tapewright.plans.feature_queries import pct
from tapewright.plans.oracle import PREP, SCREEN, SCREEN_SQL, query, r, rounded, tax, text_draw_sql, tick
from tapewright.plans.panel_queries import _INDEX, calendar, prepared

BOUNDS = {k: SCREEN[k] for k in ("low", "high", "value", "cap")}
COST = SCREEN["cost"]
_W = "PARTITION BY symbol ORDER BY date"


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training pool with gross to the next session's open, cost, net and a score."""
    p = prepared(spark, sf_dir)
    pool = C.next_session_join(U.select_universe(p, **BOUNDS), p, calendar(spark, sf_dir), ["open"])
    at = F.col("close_raw"), F.col("market"), F.col("date")
    return pool.withColumn("gross", F.col("next_open") / F.col("close") - 1).withColumn("cost_bp", M.round_trip_bp(*at)).withColumn("net", M.net_return(F.col("gross"), F.col("cost_bp"))).withColumn("pred", F.col("chg_ratio") - F.col("tick_cost_bp") / 1e4)


POOL = (
    PREP
    + f""", pool AS (SELECT p.*, c.next_date, n.open AS next_open, n.open/p.close-1 AS gross, {tax('p.date')} + 2*tick_cost_bp + 0.72792e0 AS cost_bp, n.open/p.close-1-({tax('p.date')} + 2*tick_cost_bp + 0.72792e0)/1e4 AS net, chg_ratio-tick_cost_bp/1e4 AS pred
 FROM (SELECT * FROM prep WHERE {SCREEN_SQL}) p JOIN cal c ON c.date=p.date LEFT JOIN price_history n ON n.date=c.next_date AND n.symbol=p.symbol),
 picks AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol) AS rank FROM pool QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol) <= 3),
 daily AS (SELECT date, avg(net) net FROM picks GROUP BY date HAVING count(net) > 0)"""
)


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top_k(pooled(spark, sf_dir), 3, [F.col("pred").desc()])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(spark, sf_dir).groupBy("date").agg(F.avg("net").alias("net")).where("net is not null")


@query(POOL + f", cheap AS (SELECT * FROM pool WHERE tick_cost_bp <= 60 QUALIFY row_number() OVER (PARTITION BY date ORDER BY tick_cost_bp, symbol) <= 3) SELECT date, count(*) n_picks, count(net) n_realized, {r('avg(gross)')} gross, {r('avg(net)')} net FROM cheap GROUP BY date")
def daily_pick_returns(spark, sf_dir):
    """Three names a day by cost, and what they earn at the next session's open."""
    picks = U.top_k(pooled(spark, sf_dir).where(F.col("tick_cost_bp") <= COST), 3, [F.col("tick_cost_bp").asc()])
    return rounded(picks.groupBy("date").agg(F.count("*").alias("n_picks"), F.count("net").alias("n_realized"), F.avg("gross").alias("gross"), F.avg("net").alias("net")))


@query(PREP + f" SELECT date, symbol, {r('chg_ratio')} chg_ratio, {r('tick_cost_bp')} tick_cost_bp FROM prep WHERE {SCREEN_SQL} AND tick_cost_bp <= 60")
def u1_select_universe(spark, sf_dir):
    return rounded(U.select_universe(prepared(spark, sf_dir), **BOUNDS, cost=COST).select("date", "symbol", "chg_ratio", "tick_cost_bp"))


@query(PREP + f" SELECT date, symbol, coalesce(tick_cost_bp<=60,false) AS selected FROM prep WHERE {SCREEN_SQL}")
def u2_nested_screens(spark, sf_dir):
    return U.nested_screens(prepared(spark, sf_dir), **BOUNDS, cost=COST).select("date", "symbol", "selected")


@query(PREP + f", g AS (SELECT *, lead(open) OVER ({_W})/close-1 gross FROM prep) SELECT date, count(*) n_kept, count(gross) n_with_next, {r('avg(gross)')} mean_gross FROM g WHERE {SCREEN_SQL} GROUP BY date")
def u3_screen_provenance(spark, sf_dir):
    return rounded(U.screen_with_provenance(prepared(spark, sf_dir), U.screen(**BOUNDS)))


@query(_INDEX + f" SELECT p.date, symbol, coalesce(mc_clean>=5000 AND inst_netbuy>0 AND CASE WHEN market='KOSPI' THEN kospi_pct ELSE kosdaq_pct END > 0, false) is_u3 FROM prep p LEFT JOIN idx ON idx.date=p.date WHERE {SCREEN_SQL}")
def u4_candidates(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return U.candidates(p, P.index_by_date(p), U.screen(**BOUNDS), 5000).select("date", "symbol", "is_u3")


@query(PREP + f" SELECT date, symbol, coalesce({SCREEN_SQL},false) AS inside FROM prep WHERE chg_ratio >= 0.01e0-0.05e0 AND chg_ratio < 0.29e0+0.05e0 AND tv_clean >= 0.025e0 AND mc_clean >= 500")
def u5_superset(spark, sf_dir):
    return U.superset(prepared(spark, sf_dir), **BOUNDS).select("date", "symbol", "inside")


@query(PREP + f" SELECT date, count(*) n FROM prep WHERE {SCREEN_SQL} AND tick_cost_bp <= 60 GROUP BY date")
def u6_live_admission(spark, sf_dir):
    """The same screen on a snapshot with Korean column names."""
    p = prepared(spark, sf_dir)
    live = p.withColumnsRenamed({"symbol": "종목코드", "close": "종가", "volume": "거래량"})
    back = live.withColumnsRenamed({"종목코드": "symbol", "종가": "close", "거래량": "volume"})
    return U.select_universe(back, **BOUNDS, cost=COST).groupBy("date").agg(F.count("*").alias("n"))


@query(
    PREP
    + """, a AS (SELECT *, CASE WHEN close IS NULL OR close<=0 THEN 'no_price' WHEN is_ceiling THEN 'ceiling' WHEN mc_clean IS NULL THEN 'no_cap' WHEN mc_clean<2000 THEN 'small_cap' END rs FROM prep), b AS (SELECT *, CASE WHEN rs IS NULL THEN row_number() OVER (PARTITION BY date, rs IS NULL ORDER BY tv_clean DESC NULLS LAST, symbol) END pl FROM a)
 SELECT date, symbol, CASE WHEN pl>5 THEN 'capacity' ELSE rs END reason, CASE WHEN pl>5 THEN 'capacity' ELSE rs END IS NULL AS member FROM b"""
)
def u7_select_roster(spark, sf_dir):
    return U.select_roster(prepared(spark, sf_dir), 5, 2000).select("date", "symbol", "reason", "member")


@query(POOL + f" SELECT date, symbol, rank, {r('pred')} pred, {r('net')} net FROM picks")
def u8_top_k(spark, sf_dir):
    return rounded(picked(spark, sf_dir).select("date", "symbol", "rank", "pred", "net"))


@query(POOL + " SELECT date, symbol, rank, 1.0e0/3 AS weight FROM picks WHERE date IN (SELECT date FROM pool GROUP BY date HAVING count(*)>=3)")
def u9_certified_equal_weight(spark, sf_dir):
    return U.certified_equal_weight(pooled(spark, sf_dir), 3, [F.col("pred").desc()]).select("date", "symbol", "rank", "weight")


@query(POOL + f", d AS (SELECT c.date, coalesce(n,0) n FROM cal c LEFT JOIN (SELECT date, count(*) n FROM pool GROUP BY 1) x ON x.date=c.date) SELECT CAST(year(date) AS VARCHAR) regime, count(*) n_days, count(*) FILTER (WHERE n>=3) n_feasible, {r('avg(CASE WHEN n>=3 THEN 1.0 ELSE 0.0 END)')} AS share FROM d GROUP BY 1")
def u10_feasibility(spark, sf_dir):
    return rounded(U.feasibility(pooled(spark, sf_dir), calendar(spark, sf_dir), 3, F.year("date").cast("string")))


@query(POOL + f" SELECT date, symbol, {r('CASE WHEN count(1/nullif(tick_cost_bp,0)) OVER w = count(*) OVER w THEN (1/tick_cost_bp)/sum(1/tick_cost_bp) OVER w ELSE 1.0/count(*) OVER w END')} AS weight FROM picks WINDOW w AS (PARTITION BY date)")
def u11_weights(spark, sf_dir):
    return rounded(U.weights(picked(spark, sf_dir)).select("date", "symbol", "weight"))


@query(
    POOL
    + f""", wp AS (SELECT *, (1/tick_cost_bp)/sum(1/tick_cost_bp) OVER (PARTITION BY date) wt FROM picks), m AS (SELECT date, sum(wt*net) net, count(*) n FROM wp GROUP BY 1), ch AS (SELECT date, avg(net) cost_sort_net FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY date ORDER BY tick_cost_bp NULLS LAST, symbol)<=3) GROUP BY 1), wh AS (SELECT date, avg(net) pool_net FROM pool GROUP BY 1),
 d AS (SELECT c.date, CASE WHEN coalesce(n,0)>=3 THEN net END net, cost_sort_net, pool_net, coalesce(n,0)<3 AS abstain FROM cal c LEFT JOIN m ON m.date=c.date LEFT JOIN ch ON ch.date=c.date LEFT JOIN wh ON wh.date=c.date)
 SELECT date, {r('net')} net, {r('cost_sort_net')} cost_sort_net, {r('pool_net')} pool_net, abstain, coalesce(avg(net) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) > 0, true) gate FROM d"""
)
def u12_portfolio(spark, sf_dir):
    return rounded(U.portfolio_by_date(pooled(spark, sf_dir), calendar(spark, sf_dir), 3, [F.col("pred").desc()]))


@query(POOL + f" SELECT date, symbol, CAST(floor(1e8*least(1.0e0/3,0.4e0)/close_raw) AS BIGINT) qty, floor((close_raw+tk)/tk)*tk limit_price FROM (SELECT *, {tick('close_raw', 'market', 'date')} tk FROM picks)")
def u13_position_size(spark, sf_dir):
    return U.position_size(picked(spark, sf_dir).withColumn("weight", F.lit(1.0 / 3)), 1e8).select("date", "symbol", "qty", F.col("limit_price").cast("double").alias("limit_price"))


_GRID = [("tight", 0.05, 0.29, 0.1, 2000.0), ("wide", 0.0, 0.29, 0.01, 500.0), ("base", 0.01, 0.29, 0.05, 1000.0)]


@query(
    PREP
    + f", nt AS (SELECT *, lead(open) OVER ({_W})/close-1 net FROM prep), g(name,lo,hi,v,cp) AS (VALUES "
    + ", ".join(f"('{n}',{a}e0,{b}e0,{c}e0,{d}e0)" for n, a, b, c, d in _GRID)
    + f"), d AS (SELECT name, date, avg(net) net, count(*) n FROM nt JOIN g ON chg_ratio>=lo AND chg_ratio<hi AND tv_clean>=v AND mc_clean>=cp GROUP BY 1,2) SELECT name, CAST(sum(n) AS BIGINT) n_rows, count(*) n_days, {r('avg(net)')} mean_net, row_number() OVER (ORDER BY avg(net) DESC, name) place FROM d GROUP BY name"
)
def u14_screen_grid(spark, sf_dir):
    p = U.mechanical_label(prepared(spark, sf_dir)).withColumnRenamed("gross", "net")
    return rounded(U.screen_grid(p, spark.createDataFrame(_GRID, "name string, low double, high double, value double, cap double")))


@query(POOL + " SELECT date, p.symbol, row_number() OVER (PARTITION BY date ORDER BY pred DESC, p.symbol) AS rank, row_number() OVER (PARTITION BY date ORDER BY pred DESC, p.symbol) <= 3 AS selected, s.s_name AS name FROM pool p LEFT JOIN supplier s ON lpad(CAST(s.s_suppkey AS VARCHAR),6,'0')=p.symbol")
def u15_rank_pool(spark, sf_dir):
    names = fixtures.base(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("s_name").alias("name"))
    return U.rank_pool(pooled(spark, sf_dir), 3, [F.col("pred").desc()], names).select("date", "symbol", "rank", "selected", "name")


_IMPACT = "SELECT date, symbol, (high-close)/close*1e3 AS impact_bp FROM {p} WHERE day(date)%2=0"


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = pooled(spark, sf_dir).drop("cost_bp")
    return U.row_costs(pool, spark.sql(_IMPACT, p=pool))


# A row's impact is measured on even days; the SQL takes it from the row itself, since date and symbol name one.
_COSTED = POOL + f", im AS (SELECT p.*, CASE WHEN day(p.date)%2=0 THEN (high-close)/close*1e3 END impact_bp FROM pool p), cst AS (SELECT p.*, {tax('p.date')} tax_part, 2*tick_cost_bp tick_part, coalesce(abs(impact_bp),5e0) impact_part, impact_bp IS NOT NULL measured FROM im p), cs AS (SELECT *, tax_part+tick_part+impact_part+0.72792e0 AS cbp FROM cst)"


@query(_COSTED + f" SELECT date, symbol, tax_part, {r('tick_part')} tick_part, {r('impact_part')} impact_part, measured, {r('cbp')} cost_bp FROM cs")
def l4_row_costs(spark, sf_dir):
    return rounded(costed(spark, sf_dir).select("date", "symbol", "tax_part", "tick_part", "impact_part", "measured", "cost_bp"))


@query(
    _COSTED
    + f", d AS (SELECT date, avg(tax_part) a, avg(tick_part) b, avg(impact_part) c, avg(cbp) d, avg(gross) g, avg(CASE WHEN measured THEN 1.0 ELSE 0.0 END) m FROM cs GROUP BY date) SELECT count(*) n_days, {r('avg(a)', 4)} tax_part, {r('avg(b)', 4)} tick_part, {r('avg(c)', 4)} impact_part, {r('avg(d)', 4)} cost_bp, {r('avg(m)', 4)} measured, {r('CASE WHEN count(*)>=30 THEN avg(g)*1e4-avg(d) END', 4)} break_even_bp FROM d"
)
def l5_cost_summary(spark, sf_dir):
    return rounded(U.cost_summary(costed(spark, sf_dir)), 4)


@query(POOL + f" SELECT date, symbol, {r('gross')} gross, {r('cost_bp')} cost_bp, {r('net')} net FROM pool")
def l6_net_return(spark, sf_dir):
    return rounded(pooled(spark, sf_dir).select("date", "symbol", "gross", "cost_bp", "net"))


_EXITS = (
    PREP
    + """, xp AS (SELECT p.date, p.symbol, p.close, c.pos FROM price_history p JOIN cal c ON c.date=p.date), tr AS (SELECT p.symbol, c.pos, p.open FROM price_history p JOIN cal c ON c.date=p.date WHERE open>0 AND volume>0),
 fx AS (SELECT x.date, x.symbol, x.close, x.pos, min(t.pos) tp, arg_min(t.open, t.pos) o FROM xp x LEFT JOIN tr t ON t.symbol=x.symbol AND t.pos > x.pos AND t.pos <= x.pos+20 GROUP BY 1,2,3,4), mx AS (SELECT max(pos) m FROM cal),
 ex0 AS (SELECT *, pos+1 <= m AS hn FROM fx, mx), ex1 AS (SELECT date, symbol, pos, CASE WHEN hn THEN coalesce(o, close*0.5e0) END exit_price, CASE WHEN NOT hn OR tp=pos+1 THEN 'EXIT_TRADABLE' WHEN tp IS NULL THEN 'UNRESOLVED_EXIT' ELSE 'EXIT_SUSPENDED' END status, CAST(CASE WHEN NOT hn THEN 1 WHEN tp IS NULL THEN 20 ELSE tp-pos END AS INT) holding_days FROM ex0),
 exits AS (SELECT e.date, e.symbol, exit_price, status, holding_days, c.date exit_date FROM ex1 e LEFT JOIN cal c ON c.pos=e.pos+e.holding_days)"""
)


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.price_history(spark, sf_dir)
    return U.forward_exit(p, p, C.sessions(p))


@query(_EXITS + " SELECT * FROM exits")
def l7_forward_exit(spark, sf_dir):
    return exits(spark, sf_dir)


@query(POOL + f" SELECT date, symbol, {r('least(greatest(net,-0.3e0),0.3e0)')} y, {r('least(greatest(net,-0.3e0),0.3e0)-avg(least(greatest(net,-0.3e0),0.3e0)) OVER (PARTITION BY date)')} y_demeaned FROM pool WHERE net IS NOT NULL")
def l8_label(spark, sf_dir):
    return rounded(U.label(pooled(spark, sf_dir).where("net is not null")).select("date", "symbol", "y", "y_demeaned"))


@query(
    POOL
    + f", k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY net, symbol) rk, count(*) OVER (PARTITION BY date) n FROM pool WHERE net IS NOT NULL) SELECT date, symbol, {r('least(greatest(net,-0.3e0),0.3e0)')} y, CAST(CASE WHEN n=1 THEN 2 WHEN n<5 THEN round_even((rk-1)/CAST(n-1 AS DOUBLE)*4, 0) ELSE greatest(ceil((rk-1)/CAST(n-1 AS DOUBLE)*5)-1,0) END AS INT) grade, CASE WHEN net>0.01e0 THEN 1 ELSE 0 END good, CASE WHEN net < -0.01e0 THEN 1 ELSE 0 END bad FROM k"
)
def l9_multi_targets(spark, sf_dir):
    return rounded(U.multi_targets(pooled(spark, sf_dir)).select("date", "symbol", "y", "grade", "good", "bad"))


@query(PREP + f" SELECT date, symbol, {r('g')} gross, g IS NOT NULL label_known, CASE WHEN g>0 THEN 1 WHEN g IS NOT NULL THEN 0 END up_label FROM (SELECT *, lead(open) OVER ({_W})/close-1 g FROM prep)")
def l10_mechanical_label(spark, sf_dir):
    return rounded(U.mechanical_label(prepared(spark, sf_dir)).select("date", "symbol", "gross", "label_known", "up_label"))


_NEXT = POOL + f", nx AS (SELECT p.date, p.symbol, p.chg_ratio, p.close AS entry, n.no, n.nh, n.nc FROM pool p JOIN (SELECT date, symbol, lead(open) OVER ({_W}) no, lead(high) OVER ({_W}) nh, lead(close) OVER ({_W}) nc FROM price_history) n ON n.date=p.date AND n.symbol=p.symbol)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = C.next_row(fixtures.price_history(spark, sf_dir)).select("date", "symbol", "next_open", "next_high", "next_close")
    return pooled(spark, sf_dir).select("date", "symbol", "chg_ratio", F.col("close").alias("entry")).join(nxt, ["date", "symbol"])


@query(_NEXT + f" SELECT date, symbol, {r('CASE WHEN no IS NULL THEN NULL WHEN no>=entry*1.05e0 THEN no WHEN nh>=entry*1.05e0 THEN entry*1.05e0*0.999e0 ELSE nc END', 3)} exit_price, coalesce(nh>=entry*1.05e0,false) touched FROM nx".replace("entry*1.05e0", "(entry*(1+0.05e0))").replace("*0.999e0", "*(1-0.001e0)"))
def l11_take_profit(spark, sf_dir):
    return U.take_profit(entries(spark, sf_dir), F.lit(0.05), 0.001).select("date", "symbol", F.round("exit_price", 3).alias("exit_price"), "touched")


@query(
    _NEXT
    + f""", fp AS (SELECT * FROM nx WHERE abs(chg_ratio)<0.28e0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY chg_ratio DESC, symbol)=1), t(target) AS (VALUES (0.02e0),(0.05e0),(0.1e0)), x AS (SELECT *, CASE WHEN no IS NULL THEN NULL WHEN no>=entry*(1+target) THEN no WHEN nh>=entry*(1+target) THEN entry*(1+target) ELSE nc END p FROM fp, t)
 SELECT target, count(p) n, {r('avg(p/entry-1)')} mean_ret, {r('avg(p/entry-1-(no/entry-1))')} delta, {r('avg(CASE WHEN nh>=entry*(1+target) THEN 1.0 ELSE 0.0 END)')} touch_rate FROM x GROUP BY target"""
)
def l12_exit_grid(spark, sf_dir):
    return rounded(U.exit_grid(entries(spark, sf_dir), spark.createDataFrame([(0.02,), (0.05,), (0.1,)], "target double")))


_LIQUID = ", lq AS MATERIALIZED (SELECT date, symbol, CASE WHEN day(date)%7<>0 THEN trade_value_100m*1e8 END av FROM pool WHERE day(date)%3<>0), pm AS MATERIALIZED (SELECT * FROM pool), gate AS (SELECT p.date, p.symbol, lq.date IS NOT NULL fd, av, CASE WHEN av IS NOT NULL THEN least(greatest(av*0.1e0/{n},0),1) END fr, coalesce(p.prev_close>0 AND p.close/p.prev_close>=1.29e0 AND p.close>=p.high,false) ce FROM pm p LEFT JOIN lq ON lq.date=p.date AND lq.symbol=p.symbol), gt AS (SELECT *, CASE WHEN NOT fd THEN {un} ELSE coalesce(fr>={least},false) END ok FROM gate)"


def gated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Measured rows are those of days that 3 doesn't divide; on days that 7 divides the measured value is NULL."""
    pool = pooled(spark, sf_dir)
    liquid = pool.where("day(date)%3<>0").select("date", "symbol", F.when(F.dayofmonth("date") % 7 != 0, F.col("trade_value_100m") * 1e8).alias("auction_value"))
    return U.buyability(pool, liquid, 5e6, **options)


@query(POOL + _LIQUID.format(n="5e6", un="true", least="1e0") + f" SELECT date, symbol, ce ceiling_entry, {r('fr')} fill_ratio, ok buyable, fd auction_found FROM gt")
def l13_buyability(spark, sf_dir):
    return rounded(gated(spark, sf_dir).select("date", "symbol", "ceiling_entry", "fill_ratio", "buyable", "auction_found"))


@query(POOL + _LIQUID.format(n="5e6", un="false", least="0.5e0") + f" SELECT count(*) n_rows, count_if(ce) n_ceiling, count_if(NOT fd) n_unmeasured, count_if(NOT ok) n_blocked, {r('quantile_cont(CASE WHEN NOT ok THEN av END,0.5)', 2)} blocked_median, {r('quantile_cont(CASE WHEN NOT ok THEN av END,0.25)', 2)} blocked_p25 FROM gt")
def l13_buyability_report(spark, sf_dir):
    return rounded(U.buyability_report(gated(spark, sf_dir, least_fill=0.5, require_data=True)), 2)


@query(_EXITS.replace(PREP, POOL, 1) + f", ky AS (SELECT date, symbol FROM price_history WHERE day(date)%7=0) SELECT k.date, k.symbol, {r('e.exit_price/p.close-1-p.cost_bp/1e4')} net, e.exit_date FROM ky k LEFT JOIN exits e ON e.date=k.date AND e.symbol=k.symbol LEFT JOIN pool p ON p.date=k.date AND p.symbol=k.symbol")
def l15_labels_for_keys(spark, sf_dir):
    keys = fixtures.price_history(spark, sf_dir).where("day(date)%7=0").select("date", "symbol")
    return rounded(U.labels_for_keys(keys, exits(spark, sf_dir), pooled(spark, sf_dir)).select("date", "symbol", "net", "exit_date"))


def metrics(x: str = "net") -> str:
    return f"count({x}) n, {r(f'avg({x})')} AS mean, {r(f'quantile_cont({x},0.5)')} AS median, {r(f'stddev({x})')} std, {r(f'avg(CASE WHEN {x}>0 THEN 1.0 ELSE 0.0 END)')} win_rate, {r(f'sum(CASE WHEN {x}>0 THEN {x} END)/nullif(-sum(CASE WHEN {x}<0 THEN {x} END),0)', 4)} profit_factor, {r(f'avg({x})/nullif(stddev({x}),0)*sqrt(count({x}))', 4)} t, {r(f'avg({x})/nullif(stddev({x}),0)*sqrt(252)', 4)} sharpe, {r(f'avg({x})/nullif(sqrt(avg(CASE WHEN {x} IS NOT NULL THEN pow(least({x},0),2) END)),0)*sqrt(252)', 4)} sortino"


def _metrics(df: DataFrame) -> DataFrame:
    fine = {"profit_factor", "t", "sharpe", "sortino"}
    return df.select(*(F.round(c, 4 if c in fine else 6).alias(c) if k == "double" else c for c, k in df.dtypes))


@query(POOL + f" SELECT {metrics()} FROM daily")
def e1_series_metrics(spark, sf_dir):
    return _metrics(E.series_metrics(series(spark, sf_dir)))


@query(POOL + f" SELECT CAST(year(date) AS INT) AS year, {metrics()} FROM daily GROUP BY 1")
def e2_yearly_metrics(spark, sf_dir):
    return _metrics(E.series_metrics(series(spark, sf_dir).withColumn("year", F.year("date")), by=["year"]))


@query(
    POOL
    + f", st AS (SELECT ticks, date, avg(gross-({tax('date')}+ticks*tick_cost_bp+0.72792e0)/1e4) net FROM picks, (VALUES (2e0),(3e0),(4e0)) t(ticks) GROUP BY 1,2), s2 AS (SELECT * FROM st WHERE net IS NOT NULL) SELECT ticks, {metrics()}, avg(net) > 0 AND quantile_cont(net,0.5) > 0 AS passes FROM s2 GROUP BY ticks"
)
def e3_cost_stress(spark, sf_dir):
    rows = picked(spark, sf_dir).withColumn("tax", M.tax_bp(F.col("date"))).withColumn("fee", F.lit(M.FEE_BP))
    return _metrics(E.stress(rows, (2, 3, 4)))


@query(
    POOL
    + f""", bs AS (SELECT net, row_number() OVER (ORDER BY date) i FROM daily WHERE net IS NOT NULL), pf AS (SELECT i, sum(net) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) s FROM bs UNION ALL SELECT 0, 0e0), nn AS (SELECT count(*) n FROM bs),
 dr AS (SELECT rep, block, {text_draw_sql("rep||':'||block||':1'")} % (n-9) st FROM range(500) a(rep), nn, range(1, 100000) b(block) WHERE n>=10 AND block <= ceil(n/10e0)), ms AS (SELECT rep, sum(y.s-x.s)/(count(*)*10) m FROM dr JOIN pf x ON x.i=st JOIN pf y ON y.i=st+10 GROUP BY rep)
 SELECT count(*) reps, {r('quantile_cont(m,0.025)')} low, {r('quantile_cont(m,0.975)')} high, {r('avg(CASE WHEN m<=0 THEN 1.0 ELSE 0.0 END)')} p_value FROM ms"""
)
def e4_block_bootstrap(spark, sf_dir):
    return rounded(E.block_bootstrap(series(spark, sf_dir), draw=text_draw))


# The normal distribution by Simpson's rule over 2,000 steps up to z.
_DSR_BEST = 0.05 * ((1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (20 * math.e)))


@query(
    POOL
    + f""", dm AS (SELECT net-avg(net) OVER () d, avg(net) OVER () m FROM daily), mo AS (SELECT count(*) n, max(m) m, stddev(d) s, avg(d*d*d)/pow(avg(d*d),1.5e0) sk, avg(d*d*d*d)/pow(avg(d*d),2) ku FROM dm), z AS (SELECT n, (m/s-{_DSR_BEST!r})/sqrt(greatest((1-sk*m/s+(ku-1)/4*pow(m/s,2))/(n-1),1e-12)) z FROM mo)
 SELECT n, CAST(20 AS INT) trials, {r('0.5e0 + sum(CASE WHEN i IN (0,2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END * exp(-0.5e0*pow(z*i/2000,2)))*z/2000/3/sqrt(2*pi())')} dsr FROM z, range(2001) t(i) GROUP BY n, z"""
)
def e5_deflated_sharpe(spark, sf_dir):
    return rounded(E.deflated_sharpe(series(spark, sf_dir), 20))


@query(
    POOL
    + ", dm AS (SELECT date, net-avg(net) OVER () d, avg(net) OVER () m, count(*) OVER () n FROM daily), lg AS (SELECT *, "
    + ", ".join(f"lag(d,{k}) OVER (ORDER BY date) d{k}" for k in range(1, 6))
    + " FROM dm), v AS (SELECT max(m) m, max(n) n, (sum(d*d)"
    + "".join(f"+2*(1-{k}/6e0)*coalesce(sum(d*d{k}),0)" for k in range(1, 6))
    + f")/max(n) lv FROM lg) SELECT {r('m')} AS mean, n, {r('lv')} long_var, {r('CASE WHEN lv>0 THEN m/sqrt(lv/n) END', 4)} t_nw FROM v"
)
def e6_newey_west(spark, sf_dir):
    out = E.newey_west(series(spark, sf_dir))
    return out.select(F.round("mean", 6).alias("mean"), "n", F.round("long_var", 6).alias("long_var"), F.round("t_nw", 4).alias("t_nw"))


_NAV = POOL + ", nv AS (SELECT c.date, exp(sum(ln(1+coalesce(d.net,0))) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING)) nav FROM cal c LEFT JOIN daily d ON d.date=c.date), dd AS (SELECT *, nav/greatest(max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING),1)-1 drawdown FROM nv)"


@query(_NAV + f" SELECT date, {r('ln(nav)', 5)} log_nav, {r('drawdown', 5)} drawdown FROM dd")
def e7_nav(spark, sf_dir):
    return E.nav(series(spark, sf_dir), calendar(spark, sf_dir)).select("date", F.round(F.log("nav"), 5).alias("log_nav"), F.round("drawdown", 5).alias("drawdown"))


@query(
    _NAV
    + f", w AS (SELECT net, row_number() OVER (ORDER BY net, date) rr, count(*) OVER () n FROM daily), tl AS (SELECT avg(CASE WHEN rr <= greatest(floor(n*0.05e0),1) THEN net END) cvar5, sum(CASE WHEN rr<=5 THEN net END) worst5 FROM w), g AS (SELECT arg_max(nav,date) f, min(drawdown) mdd, count(*) n FROM dd) SELECT {r('ln(f)', 5)} log_final, {r('mdd', 5)} max_drawdown, {r('cvar5')} cvar5, {r('worst5')} worst5, {r('(pow(f,252e0/n)-1)/nullif(-mdd,0)', 4)} calmar FROM g, tl"
)
def e7_nav_summary(spark, sf_dir):
    s = series(spark, sf_dir)
    out = E.nav_summary(E.nav(s, calendar(spark, sf_dir)), s)
    return out.select(F.round(F.log("final"), 5).alias("log_final"), F.round("max_drawdown", 5).alias("max_drawdown"), F.round("cvar5", 6).alias("cvar5"), F.round("worst5", 6).alias("worst5"), F.round("calmar", 4).alias("calmar"))


def _ic(a: str, b: str) -> str:
    known = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return POOL + f", i0 AS (SELECT date, {a} a, {b} b FROM pool QUALIFY count(*) OVER (PARTITION BY date) = count(*) FILTER (WHERE {known}) OVER (PARTITION BY date) AND count(*) OVER (PARTITION BY date) >= 2), i1 AS (SELECT *, {pct('a')} ra, {pct('b')} rb FROM i0), i2 AS (SELECT date, count(*) n, corr(ra,rb) ic FROM i1 GROUP BY date) SELECT date, n, {r('ic')} ic FROM i2 WHERE ic IS NOT NULL AND NOT isnan(ic)"


@query(_ic("pred", "net"))
def e8_rank_ic(spark, sf_dir):
    return rounded(E.rank_ic(pooled(spark, sf_dir), "pred", "net"))


@query(_ic("pred", "chg_ratio"))
def e9_rank_agreement(spark, sf_dir):
    return rounded(E.rank_ic(pooled(spark, sf_dir), "pred", "chg_ratio"))


@query(
    PREP
    + ", b AS (SELECT date, CAST(least(floor((pos-1)*8/count(*) OVER ()),7) AS INT) bin FROM cal), f AS (SELECT a.x t1, b.x t2, row_number() OVER (ORDER BY a.x, b.x)-1 fold FROM range(8) a(x) JOIN range(8) b(x) ON a.x<b.x) SELECT CAST(fold AS INT) fold, CASE WHEN bin IN (t1,t2) THEN 'test' ELSE 'train' END AS role, count(*) n, min(date) first_date, max(date) last_date FROM b, f WHERE bin IN (t1,t2) OR bin NOT IN (t1-1,t1+1,t2-1,t2+1) GROUP BY 1,2"
)
def e10_cpcv_folds(spark, sf_dir):
    return E.cpcv_folds(calendar(spark, sf_dir)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_WF = ", nn AS (SELECT count(*) n, count(*)//6 sz FROM cal), bl AS (SELECT k AS fold, n-(5-k)*sz AS start, n-(4-k)*sz AS stop FROM nn, range(5) t(k)), wf AS (SELECT date, CAST(fold AS INT) fold, CASE WHEN pos-1>=start AND pos-1<stop THEN 'test' WHEN pos-1 < start-5 THEN 'train' END AS role FROM cal, bl)"


@query(PREP + _WF + " SELECT fold, role, count(*) n, min(date) first_date, max(date) last_date FROM wf WHERE role IS NOT NULL GROUP BY 1,2")
def e11_walk_forward_folds(spark, sf_dir):
    return E.walk_forward_folds(calendar(spark, sf_dir)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_BLOCKS = [(0, "2023-01-02", "2022-12-20"), (1, "2024-01-02", "2023-12-20"), (2, "2025-01-02", "2024-12-20")]


@query(_EXITS + ", b(fold,ts,es) AS (VALUES " + ", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, a, b in _BLOCKS) + ") SELECT fold, count(*) n, max(exit_date) last_exit, min(date) first_date FROM exits e JOIN b ON e.exit_date < es AND e.date >= ts - 750 GROUP BY fold")
def e12_admissible_rows(spark, sf_dir):
    blocks = spark.createDataFrame(_BLOCKS, "fold int, a string, b string").select("fold", F.to_date("a").alias("test_start"), F.to_date("b").alias("embargo_start"))
    return E.admissible(exits(spark, sf_dir), blocks).groupBy("fold").agg(F.count("*").alias("n"), F.max("exit_date").alias("last_exit"), F.min("date").alias("first_date"))


@query(_EXITS + ", b(fold,ts,es) AS (VALUES " + ", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, a, b in _BLOCKS) + ") SELECT fold, NOT coalesce(e.exit_date < es,false) purged, count(*) n, min(date) first_date, max(date) last_date FROM exits e JOIN b ON e.date < ts GROUP BY 1,2")
def e13_seam_purge(spark, sf_dir):
    blocks = spark.createDataFrame(_BLOCKS, "fold int, a string, b string").select("fold", F.to_date("a").alias("test_start"), F.to_date("b").alias("embargo_start"))
    return E.seam_purge(exits(spark, sf_dir), blocks).groupBy("fold", "purged").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_OOF = ", oof AS (SELECT p.date, symbol, net, tick_cost_bp, pred + CASE WHEN fold%2=0 THEN 0.01e0 ELSE -0.01e0 END * (CAST(symbol AS INT)%5) AS pred, fold FROM pool p, range(4) t(fold) WHERE (CAST(symbol AS INT)+fold)%3<>0)"


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = spark.range(4).withColumnRenamed("id", "fold")
    rows = pooled(spark, sf_dir).crossJoin(F.broadcast(folds)).where("(CAST(symbol AS INT)+fold)%3<>0")
    return rows.withColumn("pred", F.col("pred") + F.when(F.col("fold") % 2 == 0, 0.01).otherwise(-0.01) * (F.col("symbol").cast("int") % 5))


@query(POOL + _OOF + f" SELECT date, symbol, {r('avg(pred)')} pred, count(*) n_folds, {r('arg_min(net,fold)')} net FROM oof GROUP BY 1,2")
def e14_pooled_oof(spark, sf_dir):
    return rounded(E.pooled_oof(oof(spark, sf_dir)).select("date", "symbol", "pred", "n_folds", "net"))


@query(
    POOL
    + _OOF
    + f", a AS (SELECT fold, date, avg(net) x FROM (SELECT * FROM oof QUALIFY row_number() OVER (PARTITION BY fold, date ORDER BY pred DESC, symbol)<=3) GROUP BY 1,2), b AS (SELECT fold, date, avg(net) y FROM (SELECT * FROM oof QUALIFY row_number() OVER (PARTITION BY fold, date ORDER BY tick_cost_bp NULLS LAST, symbol)<=3) GROUP BY 1,2), d AS (SELECT a.fold, x-y d FROM a JOIN b ON a.fold=b.fold AND a.date=b.date WHERE x-y IS NOT NULL) SELECT fold, count(*) n, {r('avg(d)')} mean_delta, {r('avg(CASE WHEN d>0 THEN 1.0 ELSE 0.0 END)')} win_rate, {r('avg(d)/nullif(stddev(d),0)*sqrt(count(*))', 4)} t_paired, {r('2.8015852182e0*stddev(d)/sqrt(count(*))', 5)} mde FROM d GROUP BY fold"
)
def e15_path_evidence(spark, sf_dir):
    out = E.path_evidence(oof(spark, sf_dir))
    return out.select("fold", "n", F.round("mean_delta", 6).alias("mean_delta"), F.round("win_rate", 6).alias("win_rate"), F.round("t_paired", 4).alias("t_paired"), F.round("mde", 5).alias("mde"))


@query(
    POOL
    + f", a AS (SELECT date, avg(net) x FROM picks GROUP BY 1), b AS (SELECT date, avg(net) y FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY date ORDER BY tick_cost_bp NULLS LAST, symbol)<=3) GROUP BY 1), d AS (SELECT x-y d FROM a JOIN b ON a.date=b.date WHERE x-y IS NOT NULL) SELECT count(*) n, {r('avg(d)')} mean_delta, {r('avg(CASE WHEN d>0 THEN 1.0 ELSE 0.0 END)')} win_rate, {r('avg(d)/nullif(stddev(d),0)*sqrt(count(*))', 4)} t_paired, {r('2.8015852182e0*stddev(d)/sqrt(count(*))', 5)} mde FROM d"
)
def e16_paired_test(spark, sf_dir):
    cheap = U.top_k(pooled(spark, sf_dir), 3, [F.col("tick_cost_bp").asc_nulls_last()]).groupBy("date").agg(F.avg("net").alias("cheap"))
    out = E.paired(picked(spark, sf_dir).groupBy("date").agg(F.avg("net").alias("ranker")).join(cheap, "date"), F.col("ranker") - F.col("cheap"))
    return out.select("n", F.round("mean_delta", 6).alias("mean_delta"), F.round("win_rate", 6).alias("win_rate"), F.round("t_paired", 4).alias("t_paired"), F.round("mde", 5).alias("mde"))


@query(
    POOL
    + f", tr AS (SELECT CAST(symbol AS INT)%9 AS trial, CAST(year(date) AS INT) recorded, avg(net) m, stddev(net) s, count(net) n FROM pool WHERE net IS NOT NULL GROUP BY 1,2), la AS (SELECT trial, arg_max(n,recorded) n, arg_max(m,recorded) m, arg_max(m/nullif(s,0),recorded) sh FROM tr GROUP BY 1) SELECT trial, n, {r('m')} AS mean, {r('sh')} sharpe, count(*) OVER () n_trials, row_number() OVER (ORDER BY sh DESC NULLS LAST, trial) place FROM la"
)
def e18_trial_leaderboard(spark, sf_dir):
    t = pooled(spark, sf_dir).where("net is not null").groupBy((F.col("symbol").cast("int") % 9).alias("trial"), F.year("date").alias("recorded")).agg(F.count("net").alias("n"), F.avg("net").alias("mean"), (F.avg("net") / F.nullif(F.stddev("net"), F.lit(0.0))).alias("sharpe")).withColumn("seq", F.lit(0))
    return rounded(E.trial_leaderboard(t))


@query(
    POOL
    + f", b AS (SELECT net, CAST(year(date) AS INT) y, month(date)%2=0 AS even FROM daily) SELECT CASE WHEN grouping(y)=0 THEN 'y' WHEN grouping(even)=0 THEN 'even' ELSE 'all' END cut, coalesce(CAST(y AS VARCHAR), CAST(even AS VARCHAR), 'all') AS level, count(net) n, {r('avg(net)')} AS mean FROM b GROUP BY GROUPING SETS ((y),(even),())"
)
def e19_breakdown(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("y", F.year("date")).withColumn("even", F.month("date") % 2 == 0)
    return rounded(E.breakdown(s, "net", "y", "even"))


_ARMS = ", arm AS (SELECT date, 'full' AS arm, avg(net) net FROM picks GROUP BY 1 UNION ALL SELECT date, 'thin', avg(net) FROM (SELECT * FROM pool WHERE CAST(symbol AS INT)%4<>1 QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol)<=3) GROUP BY 1)"


@query(POOL + _ARMS + f", w AS (SELECT date, max(CASE WHEN arm='full' THEN net END) f, max(CASE WHEN arm='thin' THEN net END) t FROM arm GROUP BY 1) SELECT count(*) FILTER (WHERE f IS NOT NULL AND t IS NOT NULL) n_common, count(*) FILTER (WHERE f IS NOT NULL AND t IS NULL) only_full, count(*) FILTER (WHERE f IS NULL AND t IS NOT NULL) only_other, {r('avg(f-t)')} mean_loss FROM w")
def e20_paired_arms(spark, sf_dir):
    thin = U.top_k(pooled(spark, sf_dir).where("CAST(symbol AS INT)%4<>1"), 3, [F.col("pred").desc()])
    arms = [d.groupBy("date").agg(F.avg("net").alias("net")).withColumn("arm", F.lit(n)) for n, d in (("full", picked(spark, sf_dir)), ("thin", thin))]
    return rounded(E.paired_arms(arms[0].unionByName(arms[1]), "full", "thin"))


@query(POOL + ", th AS (SELECT * FROM pool WHERE CAST(symbol AS INT)%4<>1 QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol)<=3) SELECT coalesce(a.date,b.date) AS date, count(a.symbol) n_a, count(b.symbol) n_b, count(*) FILTER (WHERE a.symbol IS NOT NULL AND b.symbol IS NOT NULL) n_common FROM picks a FULL JOIN th b ON a.date=b.date AND a.symbol=b.symbol GROUP BY 1")
def e21_arm_overlap(spark, sf_dir):
    thin = U.top_k(pooled(spark, sf_dir).where("CAST(symbol AS INT)%4<>1"), 3, [F.col("pred").desc()])
    out = E.arm_overlap(picked(spark, sf_dir), thin)
    return out.select("date", *(F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_common")))


@query(
    POOL
    + ", y AS (SELECT CAST(year(date) AS INT) y, count(*) n, avg(net) m, avg(CASE WHEN net>0 THEN 1.0 ELSE 0.0 END) w FROM daily GROUP BY 1), c AS (SELECT y gate, 'days' criterion, n>=30 passed FROM y UNION ALL SELECT y, 'mean', m>0 FROM y UNION ALL SELECT y, 'win', w>0.5e0 FROM y) SELECT gate, bool_and(passed) passed, coalesce(string_agg(criterion, ',' ORDER BY criterion) FILTER (WHERE NOT passed), '') reasons, count(*) n_criteria FROM c GROUP BY gate"
)
def e23_gate_verdict(spark, sf_dir):
    y = series(spark, sf_dir).groupBy(F.year("date").alias("gate")).agg(F.count("*").alias("n"), F.avg("net").alias("m"), F.avg((F.col("net") > 0).cast("double")).alias("w"))
    c = y.select("gate", F.explode(F.array(F.struct(F.lit("days").alias("criterion"), (F.col("n") >= 30).alias("passed")), F.struct(F.lit("mean").alias("criterion"), (F.col("m") > 0).alias("passed")), F.struct(F.lit("win").alias("criterion"), (F.col("w") > 0.5).alias("passed")))).alias("c")).select("gate", "c.*")
    return E.gate_verdict(c)
