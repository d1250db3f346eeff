"""Queries of models; their fits aren't SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import evaluate as E
from tapewright.operators import features as X
from tapewright.operators import models as L
from tapewright.operators import universe as U
from tapewright.plans.feature_queries import _F1, _LADDER
from tapewright.plans.oracle import PREP, query, r, rounded
from tapewright.plans.panel_queries import calendar, prepared
from tapewright.plans.selection_queries import POOL, pooled

_COUNTED = ("f_body", "f_upper", "f_range", "f_rank_tv", "f_rank_chg")
NAMES = ("f_body", "f_upper", "f_range", "f_log_tv", "f_log_mc", "f_rank_tv", "f_rank_chg")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the pool with its features and a label, each name of the feature contract checked."""
    return X.cross_section(pooled(spark, sf_dir)).withColumn("y", F.greatest(F.least("net", F.lit(0.3)), F.lit(-0.3)))


@query()
def m1_seed_ensemble(spark, sf_dir):
    rows = frame(spark, sf_dir)
    models = L.seed_ensemble(rows.where("date < date'2024-01-01' and net is not null"), NAMES, "y")
    return L.score(rows.where("date >= date'2024-01-01'"), models, NAMES).select("date", "symbol", F.round("pred", 9).alias("pred"))


@query()
def m2_walk_forward_oof(spark, sf_dir):
    folds = E.walk_forward_folds(calendar(spark, sf_dir), splits=3)
    out = L.oof_predictions(frame(spark, sf_dir).drop("pred").where("net is not null"), folds, 3, NAMES, "y")
    return out.select("date", "symbol", "fold", F.round("pred", 6).alias("pred"))


@query()
def m3_platt(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("won", F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double")))
    return L.platt(rows, NAMES, "won", "2022-01-01").select("date", "symbol", F.round("raw", 6).alias("raw"), F.round("probability", 6).alias("probability"))


@query()
def m5_batch_scoring(spark, sf_dir):
    """The whole pool, rows with unknown features included, scored by an ensemble that learned from its labelled rows before 2023."""
    rows = frame(spark, sf_dir)
    models = L.seed_ensemble(rows.where("date < date'2023-01-01' and net is not null"), NAMES, "y", trees=4)
    return L.score(rows, models, NAMES).select("date", "symbol", F.round("pred", 9).alias("pred"))


_SET = _LADDER.replace(PREP, POOL, 1) + f""", md AS (SELECT date, symbol, chg_ratio-quantile_cont(chg_ratio,0.5) OVER (PARTITION BY date) d FROM prep), rz AS (SELECT date, symbol, d/nullif(quantile_cont(abs(d),0.5) OVER (PARTITION BY date),0) z FROM md),
 lb AS (SELECT date, symbol, least(greatest(net,-0.3e0),0.3e0) y, net>0.01e0 good, net<-0.01e0 bad FROM pool WHERE net IS NOT NULL)"""


@query(_SET + f" SELECT l.date, l.symbol, " + ", ".join(f"CASE WHEN sc.scenario='{s}' THEN 1 ELSE 0 END is_{c}" for s, c in zip(X.SCENARIOS, X.SCENARIO_COLUMNS, strict=True)) + f", {r('CASE WHEN z IS NOT NULL THEN least(greatest(z,-5),5) END', 3)} chg_ratio_rz, {r('y')} y, CAST(good AS INT) good, CAST(bad AS INT) bad FROM lb l JOIN sc ON sc.date=l.date AND sc.symbol=l.symbol JOIN rz ON rz.date=l.date AND rz.symbol=l.symbol")
def m7_dataset_build(spark, sf_dir):
    """Labels of the pool, scenario one-hots and the robust z of the change, joined by key; the chosen features are checked against the labels."""
    panel = X.scenario_ladder(X.robust_z(prepared(spark, sf_dir), "chg_ratio"))
    hot = X.action_panel(panel.select("date", "symbol", "scenario")).drop("n_scenarios")
    X.require_no_labels([c for c in hot.columns if c.startswith("is_")] + ["chg_ratio_rz"], ["net", "y", "good", "bad"])
    labels = U.multi_targets(pooled(spark, sf_dir)).select("date", "symbol", "y", "good", "bad")
    out = labels.join(hot, ["date", "symbol"]).join(panel.select("date", "symbol", "chg_ratio_rz"), ["date", "symbol"])
    return out.withColumn("chg_ratio_rz", F.round("chg_ratio_rz", 3)).withColumn("y", F.round("y", 6))


@query(POOL + f", t AS (SELECT date, symbol, net, 'live' AS tier, 0 k FROM pool WHERE date >= DATE '2025-01-01' AND day(date)%2=0 UNION ALL SELECT date, symbol, net, 'bars', 1 FROM pool WHERE date >= DATE '2024-01-01' AND CAST(symbol AS INT)%2=0 UNION ALL SELECT date, symbol, net, 'reconstructed', 2 FROM pool WHERE date >= DATE '2023-01-01' AND CAST(symbol AS INT)%3=0 UNION ALL SELECT date, symbol, net, 'eod', 3 FROM pool) SELECT date, symbol, arg_min(tier,k) tier, {r('max(net)')} net FROM t GROUP BY 1,2")
def m8_tiered_dataset(spark, sf_dir):
    p = pooled(spark, sf_dir).select("date", "symbol", "net")
    tiers = [("live", p.where("date >= date'2025-01-01' and day(date)%2=0")), ("bars", p.where("date >= date'2024-01-01' and cast(symbol as int)%2=0")), ("reconstructed", p.where("date >= date'2023-01-01' and cast(symbol as int)%3=0")), ("eod", p)]
    return rounded(L.tiered_dataset(tiers))


@query(_F1.replace(PREP, POOL, 1).replace("FROM prep)", "FROM pool)") + " SELECT u.feature, u.n n_known, u.feature IN ('net','y','gross') is_label FROM (SELECT " + ", ".join(f"count({n}) {n}" for n in (*_COUNTED, "net")) + " FROM f1) UNPIVOT INCLUDE NULLS (n FOR feature IN (" + ", ".join((*_COUNTED, "net")) + ")) u")
def l14_leakage_guard(spark, sf_dir):
    return X.leakage_report(frame(spark, sf_dir), [*_COUNTED, "net"], ["net", "y", "gross"])


@query(POOL + f", q AS (SELECT quantile_cont(net-pred,0.1) a, quantile_cont(net-pred,0.5) b, quantile_cont(net-pred,0.9) c FROM pool WHERE net IS NOT NULL) SELECT date, symbol, {r('least(pred+a,pred+b)')} q10, {r('pred+b')} q50, {r('greatest(pred+c,pred+b)')} q90 FROM pool, q")
def m4_quantile_bands(spark, sf_dir):
    return rounded(L.quantile_bands(pooled(spark, sf_dir), "net").select("date", "symbol", "q10", "q50", "q90"))


@query(POOL + " SELECT CASE WHEN date < DATE '2024-01-01' THEN 'eod' ELSE 'store' END AS tier, count(*) n FROM pool WHERE date < DATE '2024-01-01' OR net IS NOT NULL GROUP BY 1")
def m6_training_frame(spark, sf_dir):
    p = pooled(spark, sf_dir)
    return L.training_frame(p, p, "2024-01-01").groupBy("tier").agg(F.count("*").alias("n"))
