"""What each day's pool and picks earned on both exits, and the evidence over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import market as M
from tapewright.functions.windows import clean
from tapewright.operators import ledgers as G
from tapewright.operators import universe as U
from tapewright.operators.certification import rank_correlation

#: The counterfactual's target, the largest move that a price limit allows, names that a day's correlation needs.
TARGET, LIMIT, LEAST_NAMES = 0.05, 0.31, 4


def exit_arms(pool: DataFrame) -> DataFrame:
    """Each row's status, and its gross and net return at the next open (open_*) and with a take-profit, else at the close (tp_*).

    pool: date, symbol, close, next_date, next_open, next_high, next_close,
    cost_bp. A move beyond the limit on either exit is a discontinuity of
    prices, and no return; neither has a row that isn't realised. A name twice
    on a day stops the run.
    """
    twice = F.count("*").over(W.partitionBy("date", "symbol")) > 1
    once = pool.withColumn("_twice", twice).where(F.when(F.col("_twice"), F.raise_error(F.lit("a name twice on a day")).cast("boolean")).otherwise(True)).drop("_twice")
    base = G.decision_returns(once.withColumn("next_open", F.when(F.col("next_open") > 0, F.col("next_open"))))
    priced = U.take_profit(base.withColumn("entry", F.col("close")), F.lit(TARGET)).withColumnRenamed("gross", "open_gross")
    real = F.col("status") == "REALIZED"
    bars = (clean(F.col("next_high").cast("double")) > 0) & (clean(F.col("next_close").cast("double")) > 0)
    rows = priced.withColumn("tp_gross", F.when(real & bars, F.col("exit_price") / F.col("entry") - 1))
    broken = real & ((F.abs("open_gross") > LIMIT) | (F.abs(F.coalesce("tp_gross", F.lit(0.0))) > LIMIT))
    rows = rows.withColumn("status", F.when(broken, "PRICE_DISCONTINUITY").otherwise(F.col("status"))).drop("entry", "exit_price", "touched")
    settled = F.col("status") == "REALIZED"
    arms = {f"{a}_gross": F.when(settled, F.col(f"{a}_gross")) for a in ("open", "tp")}
    return rows.withColumns(arms).withColumns({f"{a}_net": M.net_return(F.col(f"{a}_gross"), F.col("cost_bp")) for a in ("open", "tp")})


def daily_ledger(realized: DataFrame) -> DataFrame:
    """By date: counts, and on settled days the correlations of score and result, the baskets' means and the edge of the picks.

    realized: exit_arms with pred, admitted, selected, model_version. A day with
    a pending row has counts only. The picks' means are NULL unless each pick
    has its result; the admitted mean is over those that have. A correlation
    needs LEAST_NAMES names. Two model versions on a day stop the run.
    """
    sel, adm = F.coalesce("selected", F.lit(False)), F.coalesce("admitted", F.lit(False))
    rows = realized.withColumn("selected", sel).withColumn("admitted", adm)
    real = F.col("status") == "REALIZED"

    def basket(value: str) -> Column:
        whole = (F.count_if("selected") > 0) & (F.count(F.when(F.col("selected"), F.col(value))) == F.count_if("selected"))
        return F.when(whole, F.avg(F.when(F.col("selected"), F.col(value))))

    version = F.when(F.min("model_version") == F.max("model_version"), F.min("model_version")).otherwise(F.raise_error(F.lit("two model versions on a day")))
    g = rows.groupBy("date").agg(
        version.alias("model_version"), F.bool_or(F.col("status") == "PENDING").alias("_pending"),
        F.count("*").alias("n_pool"), F.count_if(real).alias("n_pool_realized"), F.count_if("admitted").alias("n_admitted"), F.count_if(F.col("admitted") & real).alias("n_admitted_realized"),
        F.count_if("selected").alias("n_selected"), F.count_if(F.col("selected") & real).alias("n_selected_realized"),
        basket("open_net").alias("selected_open_net"), basket("tp_net").alias("selected_tp_net"), F.avg(F.when(F.col("admitted"), F.col("open_net"))).alias("admitted_open_net"),
    )
    for name, part in (("ic_pool_net", rows), ("ic_admitted_net", rows.where("admitted"))):
        g = g.join(rank_correlation(part, "pred", "open_net", ["date"], LEAST_NAMES).withColumnRenamed("ic", name), "date", "left")
    g = g.withColumn("selection_edge_net", F.col("selected_open_net") - F.col("admitted_open_net"))
    figures = ["ic_pool_net", "ic_admitted_net", "selected_open_net", "selected_tp_net", "admitted_open_net", "selection_edge_net"]
    counts = [c for c in g.columns if c.startswith("n_")]
    return g.select("date", "model_version", F.when(F.col("_pending"), "PENDING").otherwise("SETTLED").alias("day_status"), *counts, *(F.when(~F.col("_pending"), F.col(c)).alias(c) for c in figures))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """One row: days, mean, deviation and t of both correlations, and the take-profit exit against the open on days that have both."""
    gap = F.when(F.col("selected_open_net").isNotNull() & F.col("selected_tp_net").isNotNull(), F.col("selected_tp_net") - F.col("selected_open_net"))
    t = lambda x: F.when(F.stddev(x) > 0, F.avg(x) / F.stddev(x) * F.sqrt(F.count(x)))
    parts = []
    for name in ("ic_pool_net", "ic_admitted_net"):
        x = F.col(name)
        parts += [F.count(x).alias(f"{name}_days"), F.avg(x).alias(f"{name}_mean"), F.stddev(x).alias(f"{name}_sd"), t(x).alias(f"{name}_t")]
    both = [(F.avg(F.when(F.col("_gap").isNotNull(), F.col(c))) * 1e4).alias(f"{c}_mean_bp") for c in ("selected_open_net", "selected_tp_net")]
    g = F.col("_gap")
    return ledger.withColumn("_gap", gap).agg(*parts, F.count(g).alias("exit_compare_days"), *both, (F.avg(g) * 1e4).alias("tp_minus_open_mean_bp"), t(g).alias("tp_minus_open_t"))
