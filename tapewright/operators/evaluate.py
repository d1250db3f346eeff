"""Metrics, tests and folds. Functions of a daily series work on tables of dates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions.windows import clean, pct_rank_avg

YEAR = 252


def one() -> WindowSpec:
    """All rows in one partition: for tables of dates only."""
    return W.partitionBy(F.lit(1))


def series_metrics(daily: DataFrame, value: str = "net", by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, deviation, win rate, profit factor, t, Sharpe, Sortino of a daily series."""
    x = F.col(value)
    g = daily.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.percentile(x, F.lit(0.5)).alias("median"),
        F.stddev(x).alias("std"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        (F.sum(F.when(x > 0, x)) / F.nullif(-F.sum(F.when(x < 0, x)), F.lit(0.0))).alias("profit_factor"),
        F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(x, F.lit(0.0)), F.lit(2))))).alias("_down"),
    )
    sd = F.nullif("std", F.lit(0.0))
    return g.withColumn("t", F.col("mean") / sd * F.sqrt("n")).withColumn("sharpe", F.col("mean") / sd * math.sqrt(YEAR)).withColumn("sortino", F.col("mean") / F.nullif("_down", F.lit(0.0)) * math.sqrt(YEAR)).drop("_down")


def stress(rows: DataFrame, ticks: Sequence[float], least: float = 0.0) -> DataFrame:
    """Daily-mean metrics at several tick assumptions, and whether each still earns: its mean and its median day do."""
    table = rows.sparkSession.createDataFrame([(float(t),) for t in ticks], "ticks double")
    net = F.col("gross") - (F.col("tax") + F.col("ticks") * F.col("tick_cost_bp") + F.col("fee")) / 1e4
    daily = rows.crossJoin(F.broadcast(table)).withColumn("net", net).groupBy("ticks", "date").agg(F.avg("net").alias("net"))
    return series_metrics(daily, by=["ticks"]).withColumn("passes", (F.col("mean") > least) & (F.col("median") > least))


def block_bootstrap(daily: DataFrame, value: str = "net", block: int = 10, reps: int = 500, seed: int = 1, draw: Callable[..., Column] = F.xxhash64, by: Sequence[str] = ()) -> DataFrame:
    """Interval of the mean by moving blocks and the share of means at or below 0, for each group of `by`.

    Blocks are differences of prefix sums: a (group, rep, block) draws its start
    by hash and joins two rows of the table of the group's dates. Groups draw
    alike, so that arms of equal days are resampled together. A series shorter
    than a block has no row; without groups one of 0 repetitions.
    """
    keys = list(by)
    x = daily.where(F.col(value).isNotNull())
    w = (W.partitionBy(*keys) if keys else one()).orderBy("date")
    n = x.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= block)
    sums = x.select(*keys, F.row_number().over(w).alias("i"), F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    sums = sums.unionByName(n.select(*keys, F.lit(0).alias("i"), F.lit(0.0).alias("s")))
    draws = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("block", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))))
    draws = draws.withColumn("start", F.pmod(draw(F.col("rep"), F.col("block"), F.lit(seed)), F.col("n") - block + 1).cast("int"))
    ends = sums.select(*keys, F.col("i").alias("start"), F.col("s").alias("s0")).join(sums.select(*keys, (F.col("i") - block).alias("start"), F.col("s").alias("s1")), [*keys, "start"])
    means = draws.join(ends, [*keys, "start"]).groupBy(*keys, "rep").agg((F.sum(F.col("s1") - F.col("s0")) / (F.count("*") * block)).alias("m"))
    return means.groupBy(*keys).agg(F.count("*").alias("reps"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_value"))


def deflated_sharpe(daily: DataFrame, trials: int, value: str = "net", sharpe_std: float = 0.05) -> DataFrame:
    """E5: moments in Spark, the closed form on one row; 0 with fewer than 3 days or no spread."""
    m = daily.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")).first()
    dsr = 0.0
    if m.n and m.n >= 3 and m.std:
        normal, sr, euler = NormalDist(), m.mean / m.std, 0.5772156649015329
        best = sharpe_std * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
        denom = math.sqrt(max((1 - m.skew * sr + (m.kurt - 1) / 4 * sr * sr) / (m.n - 1), 1e-12))
        dsr = normal.cdf((sr - best) / denom)
    return daily.sparkSession.createDataFrame([(m.n or 0, trials, float(dsr))], "n long, trials int, dsr double")


def newey_west(daily: DataFrame, lags: int = 5, value: str = "net") -> DataFrame:
    """T of the mean with Bartlett-weighted lag covariances."""
    x = daily.where(F.col(value).isNotNull())
    w = one().orderBy("date")
    d = x.crossJoin(F.broadcast(x.agg(F.avg(value).alias("_m"), F.count("*").alias("_n")))).withColumn("_d", F.col(value) - F.col("_m"))
    prods = d.select("_m", "_n", (F.col("_d") * F.col("_d")).alias("c0"), *((F.col("_d") * F.lag("_d", k).over(w)).alias(f"c{k}") for k in range(1, lags + 1)))
    var = F.sum("c0")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"c{k}"), F.lit(0.0))
    g = prods.agg(F.first("_m").alias("mean"), F.first("_n").alias("n"), (var / F.first("_n")).alias("long_var"))
    return g.withColumn("t_nw", F.when(F.col("long_var") > 0, F.col("mean") / F.sqrt(F.col("long_var") / F.col("n"))))


def nav(daily: DataFrame, cal: DataFrame, value: str = "net") -> DataFrame:
    """Compounded value on the calendar (a missing day earns 0) and its drawdown."""
    w = one().orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = cal.select("date").join(daily, "date", "left").withColumn("nav", F.exp(F.sum(F.log1p(F.coalesce(F.col(value), F.lit(0.0)))).over(w)))
    return d.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1).select("date", "nav", "drawdown")


def nav_summary(path: DataFrame, daily: DataFrame, value: str = "net") -> DataFrame:
    """Final value, largest drawdown, Calmar, mean of the worst 5 %, the worst five days' sum."""
    worst = daily.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(one().orderBy(value, "date"))).withColumn("_n", F.count("*").over(one()))
    tail = worst.agg(F.avg(F.when(F.col("_r") <= F.greatest(F.floor(F.col("_n") * 0.05), F.lit(1)), F.col(value))).alias("cvar5"), F.sum(F.when(F.col("_r") <= 5, F.col(value))).alias("worst5"))
    g = path.agg(F.max_by("nav", "date").alias("final"), F.min("drawdown").alias("max_drawdown"), F.count("*").alias("n"))
    annual = F.pow("final", YEAR / F.col("n")) - 1
    return g.crossJoin(tail).withColumn("calmar", annual / F.nullif(-F.col("max_drawdown"), F.lit(0.0)))


def rank_ic(rows: DataFrame, score: str, target: str, by: Sequence[str] = ("date",), least: int = 2) -> DataFrame:
    """Spearman by date with average ranks.

    A date has none if one of its scores or targets is unknown, if it has fewer
    than `least` rows, or if the scores or the targets are all the same.
    """
    w = W.partitionBy(*by)
    known = clean(F.col(score).cast("double")).isNotNull() & clean(F.col(target).cast("double")).isNotNull()
    x = rows.withColumn("_k", known).withColumn("_all", F.bool_and("_k").over(w) & (F.count("*").over(w) >= least)).where("_all")
    r = x.withColumn("_a", pct_rank_avg(F.col(score), by)).withColumn("_b", pct_rank_avg(F.col(target), by))
    spread = (F.min("_a").over(w) < F.max("_a").over(w)) & (F.min("_b").over(w) < F.max("_b").over(w))
    return r.withColumn("_s", spread).where("_s").groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"))


def cpcv_folds(cal: DataFrame, bins: int = 8, held: int = 2) -> DataFrame:
    """Date, fold, role for every pair of test bins; the bin before and the one after each test bin is in neither."""
    n = F.count("*").over(one())
    binned = cal.select("date", F.least(F.floor((F.col("pos") - 1) * bins / n), F.lit(bins - 1)).cast("int").alias("bin"))
    table = []
    for fold, test in enumerate(combinations(range(bins), held)):
        off = {b + d for b in test for d in (-1, 1)} - set(test)
        table += [(fold, b, "test" if b in test else "train") for b in range(bins) if b not in off]
    return binned.join(F.broadcast(cal.sparkSession.createDataFrame(table, "fold int, bin int, role string")), "bin")


def walk_forward_folds(cal: DataFrame, splits: int = 5, gap: int = 5) -> DataFrame:
    """Expanding train, test blocks from the end, `gap` sessions between."""
    n = cal.count()  # sessions
    size = n // (splits + 1)
    blocks = cal.sparkSession.createDataFrame([(k, n - (splits - k) * size, n - (splits - k - 1) * size) for k in range(splits)], "fold int, start int, stop int")
    p = F.col("pos") - 1
    rows = cal.select("date", "pos").crossJoin(F.broadcast(blocks))
    role = F.when((p >= F.col("start")) & (p < F.col("stop")), "test").when(p < F.col("start") - gap, "train")
    return rows.withColumn("role", role).where("role is not null").select("date", "fold", "role")


def admissible(rows: DataFrame, blocks: DataFrame, window_days: int = 750) -> DataFrame:
    """For each block (fold, test_start, embargo_start) the rows that the seam purge leaves, within the window."""
    return seam_purge(rows, blocks).where(~F.col("purged") & (F.col("date") >= F.date_sub("test_start", window_days))).drop("purged")


def seam_purge(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each block the rows before its test, `purged` where the exit isn't known to be before the embargo begins. blocks: a row for each fold."""
    before = rows.join(F.broadcast(blocks), F.col("date") < F.col("test_start"))
    return before.withColumn("purged", ~F.coalesce(F.col("exit_date") < F.col("embargo_start"), F.lit(False)))


def pooled_oof(predictions: DataFrame) -> DataFrame:
    """Mean score of a key over folds; the other columns of its first fold."""
    return predictions.groupBy("date", "symbol").agg(F.avg("pred").alias("pred"), F.count("*").alias("n_folds"), F.min_by("net", "fold").alias("net"), F.min_by("tick_cost_bp", "fold").alias("tick_cost_bp"))


def path_evidence(predictions: DataFrame, k: int = 3) -> DataFrame:
    """By fold: ranker against cost sort on common dates: mean difference, win rate, paired t."""
    from tapewright.operators.universe import top_k

    a = top_k(predictions, k, [F.col("pred").desc()], ["fold", "date"]).groupBy("fold", "date").agg(F.avg("net").alias("ranker"))
    b = top_k(predictions, k, [F.col("tick_cost_bp").asc_nulls_last()], ["fold", "date"]).groupBy("fold", "date").agg(F.avg("net").alias("cost_sort"))
    return paired(a.join(b, ["fold", "date"]), F.col("ranker") - F.col("cost_sort"), ["fold"])


def paired(rows: DataFrame, delta: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean, t and the least effect that the sample can tell (alpha 5 %, power 80 %)."""
    d = rows.withColumn("_d", delta).where("_d is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.avg((F.col("_d") > 0).cast("double")).alias("win_rate"), F.stddev("_d").alias("_s"))
    z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
    return d.withColumn("t_paired", F.col("mean_delta") / F.nullif("_s", F.lit(0.0)) * F.sqrt("n")).withColumn("mde", z * F.col("_s") / F.sqrt("n")).drop("_s")


def trial_leaderboard(trials: DataFrame) -> DataFrame:
    """The latest record of each trial, ordered by its Sharpe, with the number of trials beside it."""
    latest = trials.groupBy("trial").agg(F.max_by(F.struct("n", "mean", "sharpe"), F.struct("recorded", "seq")).alias("_r")).select("trial", "_r.*")
    return latest.withColumn("n_trials", F.count("*").over(one())).withColumn("place", F.row_number().over(one().orderBy(F.desc_nulls_last("sharpe"), "trial")).cast("long"))


def breakdown(daily: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """By year, by flag, and in all, in one pass."""
    g = daily.groupingSets([[first], [second], []], first, second).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.grouping(first).alias("_g1"), F.grouping(second).alias("_g2"))
    cut = F.when(F.col("_g1") == 0, F.lit(first)).when(F.col("_g2") == 0, F.lit(second)).otherwise(F.lit("all"))
    return g.select(cut.alias("cut"), F.coalesce(F.col(first).cast("string"), F.col(second).cast("string"), F.lit("all")).alias("level"), "n", "mean")


def paired_arms(arms: DataFrame, full: str, other: str) -> DataFrame:
    """Both arms side by side on common days: means, difference, and the days that only one has."""
    wide = arms.groupBy("date").pivot("arm", [full, other]).agg(F.first("net"))
    both = F.col(full).isNotNull() & F.col(other).isNotNull()
    return wide.agg(F.count_if(both).alias("n_common"), F.count_if(F.col(full).isNotNull() & F.col(other).isNull()).alias("only_full"), F.count_if(F.col(full).isNull() & F.col(other).isNotNull()).alias("only_other"), F.avg(F.when(both, F.col(full) - F.col(other))).alias("mean_loss"))


def arm_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """By date: picks of two arms in common."""
    picks = lambda df, n: df.groupBy("date").agg(F.collect_set("symbol").alias(n))  # noqa: E731  k names a date
    j = picks(a, "pa").join(picks(b, "pb"), "date", "full")
    common = F.size(F.array_intersect(F.coalesce("pa", F.array().cast("array<string>")), F.coalesce("pb", F.array().cast("array<string>"))))
    return j.select("date", F.coalesce(F.size("pa"), F.lit(0)).alias("n_a"), F.coalesce(F.size("pb"), F.lit(0)).alias("n_b"), common.alias("n_common"))


def gate_verdict(criteria: DataFrame) -> DataFrame:
    """Criteria (gate, criterion, passed) to a verdict with the failed criteria in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("criterion"))))
    return criteria.groupBy("gate").agg(F.every("passed").alias("passed"), F.concat_ws(",", failed).alias("reasons"), F.count("*").alias("n_criteria"))


def fidelity(exact: DataFrame, rebuilt: DataFrame, features: Sequence[str], score: str, k: int, day: str = "snapshot_date", name: str = "symbol") -> DataFrame:
    """By day, over names in both frames: mean relative difference of each feature, how many of the k best by `score` both pick, and their rank correlation."""
    keys, cols = [day, name], list(dict.fromkeys([*features, score]))
    j = exact.select(*keys, *(F.col(c).alias(f"{c}_x") for c in cols)).join(rebuilt.select(*keys, *(F.col(c).alias(f"{c}_y") for c in cols)), keys)
    place = lambda c: F.row_number().over(W.partitionBy(day).orderBy(F.col(c).desc_nulls_last(), name))
    r = j.withColumn("_rx", place(f"{score}_x")).withColumn("_ry", place(f"{score}_y"))
    away = [F.avg(F.abs(F.col(f"{c}_y") / F.nullif(f"{c}_x", F.lit(0.0)) - 1)).alias(f"{c}_diff") for c in features]
    return r.groupBy(day).agg(F.count("*").alias("n"), *away, F.count_if((F.col("_rx") <= k) & (F.col("_ry") <= k)).alias("n_common"), F.corr("_rx", "_ry").alias("rank_corr"))
