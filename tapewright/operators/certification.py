"""What a research result has to show: arms by day, leaderboards, regimes, verdicts, weights of training rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import market as M
from tapewright.functions.windows import clean, pct_rank_avg
from tapewright.operators import evaluate as E

REGIMES = ("pre_reform", "post_reform", "full_history")
EULER = 0.5772156649015329


def rank_correlation(rows: DataFrame, score: str, target: str, by: Sequence[str], least: int) -> DataFrame:
    """by, ic: Spearman over rows with both values; no row with fewer than `least` of them or without spread."""
    x = rows.select(*by, clean(F.col(score).cast("double")).alias("_s"), clean(F.col(target).cast("double")).alias("_t"))
    known = x.where("_s is not null and _t is not null")
    ranked = known.withColumn("_a", pct_rank_avg(F.col("_s"), by)).withColumn("_b", pct_rank_avg(F.col("_t"), by))
    w = W.partitionBy(*by)
    spread = (F.count("*").over(w) >= least) & (F.min("_a").over(w) < F.max("_a").over(w)) & (F.min("_b").over(w) < F.max("_b").over(w))
    return ranked.withColumn("_k", spread).where("_k").groupBy(*by).agg(F.corr("_a", "_b").alias("ic"))


def certification_daily(rows: DataFrame, reference: str, k: int, least_names: int = 5) -> DataFrame:
    """Date, arm, topk_net_bp, rank_ic, n_pool, overlap: each arm on each day.

    rows: date, arm, symbol, pred, net; a pool for each arm. A day counts where
    every arm has k names with a known result; on the others an arm has its
    pool's size and nothing else. Days on which an arm has no name at all have
    a row for it, too, and don't count. Ties of the score go by symbol.
    """
    known = clean(F.col("net").cast("double"))
    own = rows.select("date", "arm", "symbol", clean(F.col("pred").cast("double")).alias("pred"), known.alias("net"))
    arms = own.select("arm").distinct()  # a few
    place = F.row_number().over(W.partitionBy("date", "arm", F.col("net").isNotNull()).orderBy(F.desc_nulls_last("pred"), "symbol"))
    picked = F.col("net").isNotNull() & (place <= k)
    per = own.withColumn("_p", picked).groupBy("date", "arm").agg(
        F.count("*").alias("n_pool"), F.count("net").alias("_known"), F.avg(F.when(F.col("_p"), F.col("net"))).alias("_mean"), F.collect_set(F.when(F.col("_p"), F.col("symbol"))).alias("_picks")
    )
    grid = own.select("date").distinct().crossJoin(F.broadcast(arms)).join(per, ["date", "arm"], "left").join(rank_correlation(own, "pred", "net", ["date", "arm"], 2), ["date", "arm"], "left")
    day = W.partitionBy("date")
    counts = F.coalesce(F.min(F.coalesce("_known", F.lit(0))).over(day) >= k, F.lit(False))
    base = F.max(F.when(F.col("arm") == reference, F.col("_picks"))).over(day)
    common = F.size(F.array_intersect("_picks", "_base")) / F.lit(float(k))
    out = grid.withColumn("_ok", counts).withColumn("_base", base)
    return out.select(
        "date", "arm", F.when(F.col("_ok"), F.col("_mean") * 1e4).alias("topk_net_bp"), F.when(F.col("_ok") & (F.col("n_pool") >= least_names), F.col("ic")).alias("rank_ic"),
        F.coalesce("n_pool", F.lit(0)).alias("n_pool"), F.when(F.col("_ok"), common).alias("overlap"),
    )


def paired_deltas(daily: DataFrame, reference: str, value: str = "topk_net_bp", least_days: int = 30, **bootstrap) -> DataFrame:
    """For each other arm the reference's mean less its own on common days, with a bootstrap interval from least_days days on.

    A row for each arm, in one job: the resampling runs over all arms' daily
    differences together.
    """
    w = W.partitionBy("date")
    base = F.max(F.when(F.col("arm") == reference, F.col(value))).over(w)
    apart = daily.withColumn("_d", base - F.col(value)).where((F.col("arm") != reference) & F.col("_d").isNotNull()).select("arm", "date", F.col("_d").alias("delta"))
    means = apart.groupBy("arm").agg(F.count("*").alias("n_days"), F.avg("delta").alias("mean_delta"))
    found = E.block_bootstrap(apart, "delta", by=("arm",), **bootstrap).select("arm", "low", "high", "p_value")
    j = means.join(found, "arm", "left")
    return j.select("arm", "n_days", "mean_delta", *(F.when(F.col("n_days") >= least_days, F.col(c)).alias(c) for c in ("low", "high", "p_value")))


def series_with_intervals(daily: DataFrame, by: Sequence[str], value: str = "net", **bootstrap) -> DataFrame:
    """The metrics of each group's series with a bootstrap interval of its mean; NULL where a series is shorter than a block."""
    found = E.block_bootstrap(daily, value, by=tuple(by), **bootstrap).select(*by, F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), "p_value")
    return E.series_metrics(daily, value, by).join(found, list(by), "left")


def expected_best(trials: int, spread: float = 0.05) -> float:
    """The Sharpe ratio that the best of so many worthless trials shows."""
    normal = NormalDist()
    return spread * ((1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0


@F.pandas_udf(T.DoubleType())
def _deflated(n: pd.Series, mean: pd.Series, std: pd.Series, skew: pd.Series, kurt: pd.Series, trials: pd.Series) -> pd.Series:
    def one(n_: int, m: float, s: float, g: float, k: float, t: int) -> float:
        if not n_ or n_ < 3 or not s or s != s:
            return 0.0
        sr = m / s
        spread = math.sqrt(max((1 - g * sr + (k - 1) / 4 * sr * sr) / (n_ - 1), 1e-12))
        return NormalDist().cdf((sr - expected_best(int(t))) / spread)

    return pd.Series([one(*x) for x in zip(n, mean, std, skew, kurt, trials, strict=True)], dtype="float64")


def leaderboard(records: DataFrame, daily: DataFrame, value: str = "net") -> DataFrame:
    """The latest record of each trial of a period, its series' metrics, and the Sharpe ratio deflated by the period's number of trials.

    records: period, trial, recorded, seq, and a trial's own columns; daily:
    period, trial, date and the value. All series are summed in one grouped
    pass. A trial without a series has no metrics and a deflated ratio of 0.
    """
    keys = ["period", "trial"]
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("recorded"), F.desc("seq")))
    latest = records.withColumn("_l", last).where("_l = 1").drop("_l", "recorded", "seq").withColumn("n_trials", F.count("*").over(W.partitionBy("period")))
    x = clean(F.col(value).cast("double"))
    moments = daily.where(x.isNotNull()).groupBy(*keys).agg(F.skewness(x).alias("_g"), (F.kurtosis(x) + 3).alias("_k"))
    j = latest.join(E.series_metrics(daily, value, keys), keys, "left").join(moments, keys, "left")
    dsr = _deflated(F.coalesce("n", F.lit(0)), "mean", "std", "_g", "_k", "n_trials")
    order = [F.desc_nulls_last("sharpe"), "trial"]
    return j.withColumn("dsr", dsr).withColumn("place", F.row_number().over(W.partitionBy("period").orderBy(*order)).cast("long")).drop("_g", "_k")


def by_regime(rows: DataFrame, date: Column) -> DataFrame:
    """Each row once in the regime before or after the tick reform, and once in the full history."""
    after = date >= F.lit(M.TICK_REFORM).cast("date")
    return rows.withColumn("regime", F.explode(F.array(F.when(after, "post_reform").otherwise("pre_reform"), F.lit("full_history"))))


def regime_metrics(daily: DataFrame, feasible: DataFrame, least_share: float = 0.9) -> DataFrame:
    """For each of the three regimes its sessions, how many are feasible, the coverage's verdict and the metrics.

    daily: date, net on signal days; feasible: date, feasible for each session.
    A regime without sessions is there, too, with insufficient coverage.
    """
    names = daily.sparkSession.createDataFrame([(x,) for x in REGIMES], "regime string")
    days = by_regime(feasible, F.col("date")).groupBy("regime").agg(F.count("*").alias("n_calendar_days"), F.count_if("feasible").alias("n_days_feasible"))
    j = names.join(days, "regime", "left").join(E.series_metrics(by_regime(daily, F.col("date")), by=["regime"]), "regime", "left")
    share = F.col("n_days_feasible") / F.col("n_calendar_days")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calendar_days", "n_days_feasible", "n")]
    status = F.when(F.coalesce(share >= least_share, F.lit(False)), "OK").otherwise("INSUFFICIENT_COVERAGE")
    return j.select("regime", *counts, share.alias("feasible_day_fraction"), status.alias("coverage_status"), "mean", "median", "std", "win_rate", "t", "sharpe")


def cost_verdict(regimes: DataFrame, stress: DataFrame, least_t: float = 2.0, ticks: float = 3.0) -> DataFrame:
    """One row: verdict and its reasons in order.

    regimes: regime_metrics; stress: points of the regime after the reform.
    Too little coverage after the reform decides before any statistic; then the
    median, t and the point at `ticks` must all hold.
    """
    cells = [F.max(F.when(F.col("regime") == r, F.col(c))).alias(f"{r}_{c}") for r in REGIMES for c in ("mean", "median", "t", "coverage_status", "feasible_day_fraction")]
    point = stress.where(F.abs(F.col("ticks") - ticks) < 1e-9).agg(F.bool_or("passes").alias("_stress"))
    j = regimes.agg(*cells).crossJoin(point)
    covered = F.col("post_reform_coverage_status") == "OK"
    up = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    gates = [("post_reform_median_positive", up("post_reform_median")), ("post_reform_t_stat", F.coalesce(F.col("post_reform_t") >= least_t, F.lit(False))), (f"post_reform_{ticks:g}tick_stress", F.coalesce("_stress", F.lit(False)))]
    failed = [F.when(covered & ~ok, F.lit(f"failed gate: {name}")) for name, ok in gates]
    reasons = [
        F.when(F.col("pre_reform_coverage_status") != "OK", F.lit("pre_reform not gate-eligible")),
        F.when(up("full_history_mean") != up("post_reform_mean"), F.lit("regime break: do not pool regimes")).otherwise(F.lit("full_history for transparency only")),
        F.when(~covered, F.lit("post_reform INSUFFICIENT_COVERAGE: statistics not evaluated")),
        *failed,
    ]
    every = reduce(lambda a, b: a & b, [ok for _, ok in gates])
    verdict = F.when(~covered, "INSUFFICIENT_COVERAGE").when(every, "PASS_POST_REFORM").otherwise("FAIL")
    return j.select(verdict.alias("verdict"), F.concat_ws("; ", *reasons).alias("reasons"))


def constructible(pool: DataFrame, k: int, least_share: float = 0.95, regimes: Sequence[str] = ("post_reform",)) -> DataFrame:
    """Regime, share of the pool's days with k names; stops the run where it is below least_share, or where there is no day.

    pool: date and one row for each name.
    """
    if k < 1 or not set(regimes) <= set(REGIMES):
        raise ValueError(f"k from 1, regimes of {REGIMES}")
    n = by_regime(pool.groupBy("date").agg(F.count("*").alias("n")), F.col("date"))
    share = n.groupBy("regime").agg(F.avg((F.col("n") >= k).cast("double")).alias("share"))
    asked = pool.sparkSession.createDataFrame([(r,) for r in regimes], "regime string").join(share, "regime", "left")
    stop = F.raise_error(F.concat(F.lit("the screen is not constructible: "), "regime")).cast("double")
    return asked.select("regime", F.when(F.coalesce(F.col("share") >= least_share, F.lit(False)), F.col("share")).otherwise(stop).alias("share"))


def session_positions(dates: DataFrame, cal: DataFrame) -> DataFrame:
    """date, pos: for each date the number of sessions before it."""
    both = cal.select("date", F.lit(1).alias("_s")).unionByName(dates.select("date").distinct().select("date", F.lit(0).alias("_s")))
    flat = both.groupBy("date").agg(F.max("_s").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return flat.select("date", before.alias("pos"))  # a table of dates


def age_weights(rows: DataFrame, cal: DataFrame, block_start: str, half_life: float) -> DataFrame:
    """Rows with `weight`, 0.5 ** (age / half_life); the age in sessions before block_start, 0 from there on."""
    start = rows.sparkSession.createDataFrame([(block_start,)], "d string").select(F.to_date("d").alias("date"))
    pos = session_positions(rows.select("date").unionByName(start), cal)
    at = pos.join(F.broadcast(start), "date").select(F.col("pos").alias("_start"))
    aged = pos.crossJoin(F.broadcast(at)).select("date", F.pow(F.lit(0.5), F.greatest(F.col("_start") - F.col("pos"), F.lit(0)) / half_life).alias("weight"))
    return rows.join(F.broadcast(aged), "date")


def ranking_grades(rows: DataFrame, label: str, n_grades: int = 5) -> DataFrame:
    """Rows with `grade`, the label's quantile within its date from 0; equal labels in the order of symbols, NULL labels without grade."""
    day = W.partitionBy("date", F.col(label).isNull())
    pos = F.row_number().over(day.orderBy(label, "symbol")) - 1
    grade = F.least(F.floor(pos / F.count("*").over(day) * n_grades), F.lit(n_grades - 1)).cast("int")
    return rows.withColumn("grade", F.when(F.col(label).isNotNull(), grade))


def balanced_weights(rows: DataFrame, mode: str = "date_balanced", half_life: int | None = None) -> DataFrame:
    """Rows with `weight`: each date counts alike (date_balanced), newer dates more by half_life in dates; of mean 1.

    current: by age alone, of mean 1 over dates; without half_life every weight is NULL.
    """
    if mode not in ("current", "date_balanced") or half_life not in (None, 252, 504):
        raise ValueError("mode is current or date_balanced, half_life None, 252 or 504")
    if mode == "current" and half_life is None:
        return rows.withColumn("weight", F.lit(None).cast("double"))
    dates = rows.groupBy("date").agg(F.count("*").alias("_n"))
    age = F.row_number().over(W.orderBy(F.desc("date"))) - 1
    decay = F.exp(-math.log(2.0) * age / half_life) if half_life else F.lit(1.0)
    aged = dates.withColumn("_w", decay if mode == "current" else decay / F.col("_n"))
    every = W.partitionBy(F.lit(1))  # a table of dates
    mean = F.avg("_w").over(every) if mode == "current" else F.sum(F.col("_w") * F.col("_n")).over(every) / F.sum("_n").over(every)
    return rows.join(F.broadcast(aged.select("date", (F.col("_w") / mean).alias("weight"))), "date")
