"""Attribution, certification, leaderboards, regimes, intervals and training weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import market as M
from tapewright.functions.windows import text_draw
from tapewright.operators import attribution as A
from tapewright.operators import certification as K
from tapewright.operators import evaluate as E
from tapewright.plans import fixtures
from tapewright.plans.feature_queries import pct
from tapewright.plans.oracle import PREP, query, r, rounded, tax, text_draw_sql
from tapewright.plans.panel_queries import calendar
from tapewright.plans.selection_queries import POOL, _metrics, metrics, picked, pooled, series

# G11

_EXITS = (
    POOL
    + """, ex0 AS (SELECT p.*, n.high nh, n.close nc, row_number() OVER (PARTITION BY p.date ORDER BY pred DESC, p.symbol)<=3 sel, coalesce(tick_cost_bp<=40,false) adm FROM pool p LEFT JOIN price_history n ON n.date=p.next_date AND n.symbol=p.symbol),
 ex1 AS (SELECT *, CASE WHEN next_date IS NULL THEN 'PENDING' WHEN next_open > 0 THEN 'REALIZED' ELSE 'NO_EXIT' END st, next_open/close-1 og, CASE WHEN next_open > 0 AND nh > 0 AND nc > 0 THEN CASE WHEN next_open >= close*(1+0.05e0) THEN next_open WHEN nh >= close*(1+0.05e0) THEN close*(1+0.05e0) ELSE nc END/close-1 END tg FROM ex0),
 ex2 AS (SELECT *, CASE WHEN st='REALIZED' AND (abs(og)>0.31e0 OR abs(coalesce(tg,0))>0.31e0) THEN 'PRICE_DISCONTINUITY' ELSE st END status FROM ex1),
 ex AS (SELECT *, CASE WHEN status='REALIZED' THEN og-cost_bp/1e4 END open_net, CASE WHEN status='REALIZED' THEN tg-cost_bp/1e4 END tp_net FROM ex2)"""
)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pooled(spark, sf_dir)
    later = fixtures.price_history(spark, sf_dir).select(F.col("date").alias("next_date"), "symbol", F.col("high").alias("next_high"), F.col("close").alias("next_close"))
    place = F.row_number().over(W.partitionBy("date").orderBy(F.desc("pred"), "symbol"))
    marked = p.withColumns({"selected": place <= 3, "admitted": F.col("tick_cost_bp") <= 40, "model_version": F.lit("v1")})
    return A.exit_arms(marked.join(later, ["next_date", "symbol"], "left"))


@query(_EXITS + f" SELECT date, symbol, status, {r('open_net')} open_net, {r('tp_net')} tp_net FROM ex")
def g11_exit_arms(spark, sf_dir):
    return rounded(arms(spark, sf_dir).select("date", "symbol", "status", "open_net", "tp_net"))


def _corr(name: str, where: str) -> str:
    return f"{name}0 AS (SELECT date, pred a, open_net b FROM ex WHERE pred IS NOT NULL AND open_net IS NOT NULL AND {where}), {name}1 AS (SELECT *, {pct('a')} ra, {pct('b')} rb FROM {name}0), {name} AS (SELECT date, CASE WHEN count(*)>=4 AND min(ra)<max(ra) AND min(rb)<max(rb) THEN corr(ra,rb) END ic FROM {name}1 GROUP BY date)"


_LEDGER = (
    _EXITS
    + f""", {_corr('ica', 'true')}, {_corr('icb', 'adm')},
 dg AS (SELECT date, bool_or(status='PENDING') pend, count(*) n_pool, count(*) FILTER (WHERE status='REALIZED') n_pool_realized, count(*) FILTER (WHERE adm) n_admitted, count(*) FILTER (WHERE adm AND status='REALIZED') n_admitted_realized, count(*) FILTER (WHERE sel) n_selected, count(*) FILTER (WHERE sel AND status='REALIZED') n_selected_realized,
  CASE WHEN count(open_net) FILTER (WHERE sel)=count(*) FILTER (WHERE sel) THEN avg(open_net) FILTER (WHERE sel) END so, CASE WHEN count(tp_net) FILTER (WHERE sel)=count(*) FILTER (WHERE sel) THEN avg(tp_net) FILTER (WHERE sel) END sp, avg(open_net) FILTER (WHERE adm) ao FROM ex GROUP BY date),
 lg AS (SELECT dg.date, CASE WHEN pend THEN 'PENDING' ELSE 'SETTLED' END day_status, n_pool, n_pool_realized, n_admitted, n_admitted_realized, n_selected, n_selected_realized, CASE WHEN NOT pend THEN ica.ic END ic_pool_net, CASE WHEN NOT pend THEN icb.ic END ic_admitted_net, CASE WHEN NOT pend THEN so END selected_open_net, CASE WHEN NOT pend THEN sp END selected_tp_net, CASE WHEN NOT pend THEN ao END admitted_open_net, CASE WHEN NOT pend THEN so-ao END selection_edge_net FROM dg LEFT JOIN ica ON ica.date=dg.date LEFT JOIN icb ON icb.date=dg.date)"""
)


@query(_LEDGER + f" SELECT date, 'v1' model_version, day_status, n_pool, n_pool_realized, n_admitted, n_admitted_realized, n_selected, n_selected_realized, {r('ic_pool_net')} ic_pool_net, {r('ic_admitted_net')} ic_admitted_net, {r('selected_open_net')} selected_open_net, {r('selected_tp_net')} selected_tp_net, {r('admitted_open_net')} admitted_open_net, {r('selection_edge_net')} selection_edge_net FROM lg")
def g11_attribution(spark, sf_dir):
    return rounded(A.daily_ledger(arms(spark, sf_dir)))


def _moments(c: str) -> str:
    return f"count({c}) {c}_days, {r(f'avg({c})')} {c}_mean, {r(f'stddev({c})')} {c}_sd, {r(f'CASE WHEN stddev({c})>0 THEN avg({c})/stddev({c})*sqrt(count({c})) END', 4)} {c}_t"


_GAP = "selected_tp_net-selected_open_net"


@query(_LEDGER + f" SELECT {_moments('ic_pool_net')}, {_moments('ic_admitted_net')}, count({_GAP}) exit_compare_days, {r(f'avg(CASE WHEN {_GAP} IS NOT NULL THEN selected_open_net END)*1e4', 4)} selected_open_net_mean_bp, {r(f'avg(CASE WHEN {_GAP} IS NOT NULL THEN selected_tp_net END)*1e4', 4)} selected_tp_net_mean_bp, {r(f'avg({_GAP})*1e4', 4)} tp_minus_open_mean_bp, {r(f'CASE WHEN stddev({_GAP})>0 THEN avg({_GAP})/stddev({_GAP})*sqrt(count({_GAP})) END', 4)} tp_minus_open_t FROM lg")
def g11_attribution_summary(spark, sf_dir):
    s = A.ledger_summary(A.daily_ledger(arms(spark, sf_dir)))
    return s.select(*(F.round(c, 4 if c.endswith(("_t", "_bp")) else 6).alias(c) if t == "double" else c for c, t in s.dtypes))


# E20, E21

_CERT = (
    POOL
    + f""", cm AS (SELECT date, 'full' arm, symbol, pred, net FROM pool UNION ALL SELECT date, 'thin', symbol, pred, net FROM pool WHERE CAST(symbol AS INT)%4<>1 UNION ALL SELECT date, 'cheap', symbol, -tick_cost_bp, net FROM pool),
 cr AS (SELECT *, row_number() OVER (PARTITION BY date, arm, net IS NOT NULL ORDER BY pred DESC NULLS LAST, symbol) pl FROM cm), pk AS (SELECT * FROM cr WHERE net IS NOT NULL AND pl<=3),
 c0 AS (SELECT date, arm, pred a, net b FROM cm WHERE pred IS NOT NULL AND net IS NOT NULL), c1 AS (SELECT *, {pct('a', 'date, arm')} ra, {pct('b', 'date, arm')} rb FROM c0), ci AS (SELECT date, arm, CASE WHEN count(*)>=2 AND min(ra)<max(ra) AND min(rb)<max(rb) THEN corr(ra,rb) END ic FROM c1 GROUP BY 1,2),
 pa AS (SELECT date, arm, count(*) n_pool, count(net) kn, avg(CASE WHEN net IS NOT NULL AND pl<=3 THEN net END) m FROM cr GROUP BY 1,2), ov AS (SELECT a.date, a.arm, count(*) n FROM pk a JOIN pk b ON b.arm='full' AND b.date=a.date AND b.symbol=a.symbol GROUP BY 1,2),
 gd AS (SELECT d.date, t.arm, coalesce(n_pool,0) n_pool, m, ic, coalesce(ov.n,0) common, min(coalesce(kn,0)) OVER (PARTITION BY d.date)>=3 ok FROM (SELECT DISTINCT date FROM cm) d CROSS JOIN (SELECT DISTINCT arm FROM cm) t LEFT JOIN pa ON pa.date=d.date AND pa.arm=t.arm LEFT JOIN ci ON ci.date=d.date AND ci.arm=t.arm LEFT JOIN ov ON ov.date=d.date AND ov.arm=t.arm),
 ce AS (SELECT date, arm, CASE WHEN ok THEN m*1e4 END topk_net_bp, CASE WHEN ok AND n_pool>=5 THEN ic END rank_ic, n_pool, CASE WHEN ok THEN common/3e0 END overlap FROM gd)"""
)


def certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pooled(spark, sf_dir).select("date", "symbol", "pred", "net", "tick_cost_bp")
    full = p.withColumn("arm", F.lit("full"))
    thin = p.where("CAST(symbol AS INT)%4<>1").withColumn("arm", F.lit("thin"))
    cheap = p.withColumn("pred", -F.col("tick_cost_bp")).withColumn("arm", F.lit("cheap"))
    return K.certification_daily(full.unionByName(thin).unionByName(cheap).drop("tick_cost_bp"), "full", 3)


@query(_CERT + f" SELECT date, arm, {r('topk_net_bp', 4)} topk_net_bp, {r('rank_ic')} rank_ic, n_pool, {r('overlap')} overlap FROM ce")
def e21_certification_daily(spark, sf_dir):
    return rounded(certification(spark, sf_dir).withColumn("topk_net_bp", F.round("topk_net_bp", 4)))


def _bootstrap(source: str, keys: str) -> str:
    """SQL of E4 by group over a table (keys, date, x)."""
    on = " AND ".join(f"{{0}}.{k}={{1}}.{k}" for k in keys.split(", "))
    q = ", ".join(f"d.{k}" for k in keys.split(", "))
    return f"""bs AS (SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY date) i FROM {source} WHERE x IS NOT NULL), nn AS (SELECT {keys}, count(*) n FROM bs GROUP BY {keys} HAVING count(*)>=10), pf AS (SELECT {keys}, i, sum(x) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) s FROM bs UNION ALL SELECT {keys}, 0, 0e0 FROM nn),
 dr AS (SELECT nn.*, rep, block, {text_draw_sql("rep||':'||block||':1'")} % (n-9) st FROM nn, range(500) a(rep), range(1, 1000) b(block) WHERE block <= ceil(n/10e0)), ms AS (SELECT {q}, d.rep, sum(y.s-z.s)/(count(*)*10) m FROM dr d JOIN pf z ON {on.format('z', 'd')} AND z.i=d.st JOIN pf y ON {on.format('y', 'd')} AND y.i=d.st+10 GROUP BY {q}, d.rep),
 bo AS (SELECT {keys}, quantile_cont(m,0.025) lo, quantile_cont(m,0.975) hi, avg(CASE WHEN m<=0 THEN 1.0 ELSE 0.0 END) pv FROM ms GROUP BY {keys})"""


@query(_CERT + f", de AS (SELECT c.arm, c.date, f.topk_net_bp-c.topk_net_bp x FROM ce c JOIN ce f ON f.date=c.date AND f.arm='full' WHERE c.arm<>'full'), {_bootstrap('de', 'arm')}, mu AS (SELECT arm, count(x) n_days, avg(x) mx FROM de WHERE x IS NOT NULL GROUP BY arm) SELECT arm, n_days, {r('mx', 4)} mean_delta, {r('CASE WHEN n_days>=30 THEN lo END', 4)} low, {r('CASE WHEN n_days>=30 THEN hi END', 4)} high, {r('CASE WHEN n_days>=30 THEN pv END')} p_value FROM mu LEFT JOIN bo USING (arm)")
def e20_paired_intervals(spark, sf_dir):
    """What the full arm earns over each other one on common days, with an interval for each arm in one job."""
    out = K.paired_deltas(certification(spark, sf_dir), "full", draw=text_draw)
    return out.select("arm", "n_days", *(F.round(c, 4).alias(c) for c in ("mean_delta", "low", "high")), F.round("p_value", 6).alias("p_value"))


@query(POOL + f", yr AS (SELECT CAST(year(date) AS INT) AS year, date, net x FROM daily), {_bootstrap('yr', 'year')}, me AS (SELECT year, {metrics('x')} FROM yr GROUP BY year) SELECT me.*, {r('lo')} ci_low, {r('hi')} ci_high, {r('pv')} p_value FROM me LEFT JOIN bo USING (year)")
def e1_intervals_by_year(spark, sf_dir):
    return _metrics(K.series_with_intervals(series(spark, sf_dir).withColumn("year", F.year("date")), ["year"], draw=text_draw))


# E18

_BEST = ", ".join(f"({n}, {K.expected_best(n)!r}e0)" for n in range(1, 10))


@query(
    POOL
    + f""", td AS (SELECT CAST(year(date) AS INT) AS period, CAST(symbol AS INT)%9 AS trial, date, avg(net) net FROM pool WHERE net IS NOT NULL GROUP BY 1,2,3), tm AS (SELECT *, net-avg(net) OVER (PARTITION BY period, trial) d FROM td), lb AS (SELECT period, trial, {metrics()}, avg(net)/nullif(stddev(net),0)*sqrt(252) sh, avg(net)/nullif(stddev(net),0) sr, avg(d*d*d)/nullif(pow(avg(d*d),1.5e0),0) sk, avg(d*d*d*d)/nullif(pow(avg(d*d),2),0) ku, count(*) OVER (PARTITION BY period) n_trials FROM tm GROUP BY 1,2),
 bt(k,best) AS (VALUES {_BEST}), zz AS (SELECT lb.*, CASE WHEN n>=3 AND sr IS NOT NULL THEN greatest(least((sr-best)/sqrt(greatest((1-sk*sr+(ku-1)/4*sr*sr)/(n-1),1e-12)), 9e0), -9e0) END z FROM lb JOIN bt ON bt.k=n_trials)
 SELECT period, trial, 'latest' AS note, n, mean, median, std, win_rate, profit_factor, t, sharpe, sortino, n_trials, {r("coalesce(0.5e0 + (SELECT sum(CASE WHEN i IN (0,2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END * exp(-0.5e0*pow(z*i/2000,2))) FROM range(2001) q(i))*z/2000/3/sqrt(2*pi()),0)", 5)} dsr, row_number() OVER (PARTITION BY period ORDER BY sh DESC NULLS LAST, trial) place FROM zz"""
)
def e18_leaderboard(spark, sf_dir):
    """By year, the trials' latest records with the metrics of their series, deflated by the year's number of trials."""
    p = pooled(spark, sf_dir).where("net is not null")
    daily = p.groupBy(F.year("date").alias("period"), (F.col("symbol").cast("int") % 9).alias("trial"), "date").agg(F.avg("net").alias("net"))
    ends = daily.groupBy("period", "trial").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    records = ends.select("period", "trial", F.inline(F.array(F.struct(F.col("first").alias("recorded"), F.lit(0).alias("seq"), F.lit("older").alias("note")), F.struct(F.col("last").alias("recorded"), F.lit(1).alias("seq"), F.lit("latest").alias("note")))))
    out = K.leaderboard(records, daily)
    return _metrics(out.withColumn("dsr", F.round("dsr", 5)))


# E2, E3, U10

_REGIME = POOL + ", fz AS (SELECT c.date, coalesce(n,0)>=3 feasible FROM cal c LEFT JOIN (SELECT date, count(*) n FROM pool GROUP BY 1) x ON x.date=c.date), rg(regime) AS (VALUES ('pre_reform'),('post_reform'),('full_history'))"
_IN = f"(regime='full_history' OR (regime='post_reform') = ({{0}} >= DATE '{M.TICK_REFORM}'))"
_REGIMES = (
    _REGIME
    + f", rd AS (SELECT regime, count(date) n_calendar_days, count(*) FILTER (WHERE feasible) n_days_feasible FROM rg LEFT JOIN fz ON {_IN.format('fz.date')} GROUP BY 1), rm AS (SELECT regime, {metrics()}, avg(net) m0, quantile_cont(net,0.5) md0, avg(net)/nullif(stddev(net),0)*sqrt(count(net)) t0 FROM daily JOIN rg ON {_IN.format('daily.date')} GROUP BY 1), re AS (SELECT rd.*, coalesce(n,0) n, n_days_feasible/CAST(n_calendar_days AS DOUBLE) fdf, CASE WHEN n_days_feasible/CAST(n_calendar_days AS DOUBLE) >= {{share}} THEN 'OK' ELSE 'INSUFFICIENT_COVERAGE' END coverage_status, mean, median, std, win_rate, t, sharpe, m0, md0, t0 FROM rd LEFT JOIN rm USING (regime))"
)


def feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pooled(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"))
    return calendar(spark, sf_dir).select("date").join(n, "date", "left").select("date", (F.coalesce("n", F.lit(0)) >= 3).alias("feasible"))


@query(_REGIMES.format(share="0.9e0") + f" SELECT regime, n_calendar_days, n_days_feasible, n, {r('fdf')} feasible_day_fraction, coverage_status, mean, median, std, win_rate, t, sharpe FROM re")
def e2_regime_metrics(spark, sf_dir):
    return _metrics(K.regime_metrics(series(spark, sf_dir), feasible(spark, sf_dir)))


@query(
    _REGIMES.format(share="0.05e0")
    + f""", ss AS (SELECT date, avg(gross-({tax('date')}+3e0*tick_cost_bp+0.72792e0)/1e4) net FROM picks WHERE date >= DATE '{M.TICK_REFORM}' GROUP BY 1), sp AS (SELECT coalesce(avg(net)>0 AND quantile_cont(net,0.5)>0,false) ok FROM ss),
 vv AS (SELECT max(CASE WHEN regime='pre_reform' THEN coverage_status END) pre, max(CASE WHEN regime='post_reform' THEN coverage_status END) post, coalesce(max(CASE WHEN regime='full_history' THEN m0 END)>0,false) fm, coalesce(max(CASE WHEN regime='post_reform' THEN m0 END)>0,false) pm, coalesce(max(CASE WHEN regime='post_reform' THEN md0 END)>0,false) g1, coalesce(max(CASE WHEN regime='post_reform' THEN t0 END)>=2,false) g2, max(CAST(ok AS INT))=1 g3 FROM re, sp)
 SELECT CASE WHEN post<>'OK' THEN 'INSUFFICIENT_COVERAGE' WHEN g1 AND g2 AND g3 THEN 'PASS_POST_REFORM' ELSE 'FAIL' END verdict, concat_ws('; ', CASE WHEN pre<>'OK' THEN 'pre_reform not gate-eligible' END, CASE WHEN fm<>pm THEN 'regime break: do not pool regimes' ELSE 'full_history for transparency only' END, CASE WHEN post<>'OK' THEN 'post_reform INSUFFICIENT_COVERAGE: statistics not evaluated' END, CASE WHEN post='OK' AND NOT g1 THEN 'failed gate: post_reform_median_positive' END, CASE WHEN post='OK' AND NOT g2 THEN 'failed gate: post_reform_t_stat' END, CASE WHEN post='OK' AND NOT g3 THEN 'failed gate: post_reform_3tick_stress' END) reasons FROM vv"""
)
def e3_cost_verdict(spark, sf_dir):
    """The derived panel is sparse, so that a regime is covered from one session in twenty on."""
    rows = picked(spark, sf_dir).where(F.col("date") >= F.lit(M.TICK_REFORM).cast("date")).withColumn("tax", M.tax_bp(F.col("date"))).withColumn("fee", F.lit(M.FEE_BP))
    return K.cost_verdict(K.regime_metrics(series(spark, sf_dir), feasible(spark, sf_dir), 0.05), E.stress(rows, (2, 3, 4)))


@query(POOL + f", dn AS (SELECT date, count(*) n FROM pool GROUP BY 1) SELECT regime, {r('avg(CASE WHEN n>=1 THEN 1.0 ELSE 0.0 END)')} AS share FROM dn JOIN (VALUES ('post_reform'),('full_history')) g(regime) ON {_IN.format('dn.date')} GROUP BY 1")
def u10_constructible(spark, sf_dir):
    return rounded(K.constructible(pooled(spark, sf_dir), 1, regimes=("post_reform", "full_history")))


# E17


@query(PREP + f", bp AS (SELECT count(*) p FROM cal WHERE date < DATE '2025-06-01') SELECT date, {r('pow(0.5e0, greatest(p-(pos-1),0)/252e0)')} AS weight FROM cal, bp")
def e17_age_weights(spark, sf_dir):
    """Ages in sessions before a block that begins on a day which need be no session."""
    cal = calendar(spark, sf_dir)
    return rounded(K.age_weights(cal.select("date"), cal, "2025-06-01", 252.0))


@query(POOL + ", gr AS (SELECT date, symbol, net, row_number() OVER (PARTITION BY date, net IS NULL ORDER BY net, symbol)-1 p, count(*) OVER (PARTITION BY date, net IS NULL) n FROM pool) SELECT date, symbol, CASE WHEN net IS NOT NULL THEN CAST(least(floor(p/CAST(n AS DOUBLE)*5),4) AS INT) END grade FROM gr")
def e17_ranking_grades(spark, sf_dir):
    return K.ranking_grades(pooled(spark, sf_dir), "net").select("date", "symbol", "grade")


@query(POOL + f", dc AS (SELECT date, count(*) n, exp(-ln(2e0)*(row_number() OVER (ORDER BY date DESC)-1)/252)/count(*) w FROM pool GROUP BY date), mw AS (SELECT sum(w*n)/sum(n) m FROM dc) SELECT p.date, p.symbol, {r('w/m')} AS weight FROM pool p JOIN dc ON dc.date=p.date, mw")
def e17_balanced_weights(spark, sf_dir):
    return rounded(K.balanced_weights(pooled(spark, sf_dir).select("date", "symbol"), half_life=252))
