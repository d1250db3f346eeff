"""Screens, selection, weights, costs by row, labels and exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions import market as M
from tapewright.functions.checks import first_reason
from tapewright.functions.windows import clip


def screen(low: float, high: float, value: float, cap: float, cost: float | None = None) -> Column:
    """The selection screen as one predicate; without `cost` it is the training screen."""
    keep = (F.col("chg_ratio") >= low) & (F.col("chg_ratio") < high) & (F.col("tv_clean") >= value) & (F.col("mc_clean") >= cap) & (F.col("close_raw") > 0) & (F.col("volume") > 0) & ~F.col("is_ceiling")
    return keep if cost is None else keep & (F.col("tick_cost_bp") <= cost)


def select_universe(panel: DataFrame, low: float, high: float, value: float, cap: float, cost: float | None = None) -> DataFrame:
    return panel.where(screen(low, high, value, cap, cost))


def nested_screens(panel: DataFrame, low: float, high: float, value: float, cap: float, cost: float) -> DataFrame:
    """The training pool with `selected` for the rows that also meet the cost cap."""
    return panel.where(screen(low, high, value, cap)).withColumn("selected", F.coalesce(F.col("tick_cost_bp") <= cost, F.lit(False)))


def screen_with_provenance(panel: DataFrame, keep: Column, index_up: Column | None = None) -> DataFrame:
    """Kept rows by date with the next open's gross and how many rows had one."""
    w = W.partitionBy("symbol").orderBy("date")
    rows = panel.withColumn("gross", F.lead("open").over(w) / F.col("close") - 1)
    rows = rows.where(keep & index_up if index_up is not None else keep)
    return rows.groupBy("date").agg(F.count("*").alias("n_kept"), F.count("gross").alias("n_with_next"), F.avg("gross").alias("mean_gross"))


def candidates(panel: DataFrame, index: DataFrame, keep: Column, cap: float) -> DataFrame:
    """U4: kept rows with is_u3: large, bought by institutions, own board up."""
    j = panel.where(keep).join(index.select("date", "kospi_pct", "kosdaq_pct"), "date", "left")
    own = F.when(F.col("market") == "KOSPI", F.col("kospi_pct")).otherwise(F.col("kosdaq_pct"))
    return j.withColumn("is_u3", F.coalesce((F.col("mc_clean") >= cap) & (F.col("inst_netbuy") > 0) & (own > 0), F.lit(False)))


def superset(panel: DataFrame, low: float, high: float, value: float, cap: float, slack: float = 0.05) -> DataFrame:
    """Wider bounds, with `inside` for the rows of the screen itself; every such row is in the superset."""
    wide = (F.col("chg_ratio") >= low - slack) & (F.col("chg_ratio") < high + slack) & (F.col("tv_clean") >= value / 2) & (F.col("mc_clean") >= cap / 2)
    return panel.where(wide).withColumn("inside", F.coalesce(screen(low, high, value, cap), F.lit(False)))


def select_roster(rows: DataFrame, capacity: int, least_cap: float) -> DataFrame:
    """Drop reasons in order, then by value, up to the capacity."""
    reason = first_reason([("no_price", F.col("close").isNull() | (F.col("close") <= 0)), ("ceiling", F.col("is_ceiling")), ("no_cap", F.col("mc_clean").isNull()), ("small_cap", F.col("mc_clean") < least_cap)])
    r = rows.withColumn("reason", reason)
    place = F.row_number().over(W.partitionBy("date", F.col("reason").isNull()).orderBy(F.col("tv_clean").desc_nulls_last(), "symbol"))
    r = r.withColumn("place", F.when(F.col("reason").isNull(), place))
    return r.withColumn("reason", F.when(F.col("place") > capacity, "capacity").otherwise(F.col("reason"))).withColumn("member", F.col("reason").isNull())


def top_k(rows: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ("date",)) -> DataFrame:
    """U8: the first k of each group; ties by symbol."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order, "symbol")).cast("long")).where(F.col("rank") <= k)


def certified_equal_weight(rows: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Dates with k rows at least; weight 1 / k."""
    n = F.count("*").over(W.partitionBy("date"))
    return top_k(rows.withColumn("_n", n).where(F.col("_n") >= k).drop("_n"), k, order).withColumn("weight", F.lit(1.0 / k))


def feasibility(pool: DataFrame, cal: DataFrame, k: int, regime: Column) -> DataFrame:
    """By regime: sessions, sessions with k names, share."""
    n = pool.groupBy("date").agg(F.count("*").alias("n"))
    days = cal.select("date").join(n, "date", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("regime", regime)
    return days.groupBy("regime").agg(F.count("*").alias("n_days"), F.count_if(F.col("n") >= k).alias("n_feasible"), F.avg((F.col("n") >= k).cast("double")).alias("share"))


def weights(picks: DataFrame, how: str = "inverse_tick") -> DataFrame:
    """Equal, inverse_tick (equal where a cost is missing) or score weights, which sum to 1 by date."""
    w = W.partitionBy("date")
    equal = 1.0 / F.count("*").over(w)
    if how == "equal":
        return picks.withColumn("weight", equal)
    base = 1.0 / F.nullif("tick_cost_bp", F.lit(0.0)) if how == "inverse_tick" else F.greatest(F.col("score"), F.lit(0.0))
    rows = picks.withColumn("_b", base)
    whole = (F.count("_b").over(w) == F.count("*").over(w)) & (F.sum("_b").over(w) > 0)
    return rows.withColumn("weight", F.when(whole, F.col("_b") / F.sum("_b").over(w)).otherwise(equal)).drop("_b")


def portfolio_by_date(pool: DataFrame, cal: DataFrame, k: int, order: Sequence[Column], gate_rows: int = 20) -> DataFrame:
    """By session: the picks' net, the pool's mean, the cheapest k's net, whether to abstain, the trailing gate."""
    by_date = W.partitionBy("date")
    place = lambda by: F.row_number().over(by_date.orderBy(*by, "symbol"))
    ranked = pool.select("date", "net", (1.0 / F.nullif("tick_cost_bp", F.lit(0.0))).alias("_b"), place(order).alias("_r"), place([F.col("tick_cost_bp").asc_nulls_last()]).alias("_c"))
    picked, cheapest = F.col("_r") <= k, F.col("_c") <= k
    # Inverse-tick weights that sum to 1 over the picks; equal ones where a cost is missing.
    n, known = F.count_if(picked), F.count_if(picked & F.col("_b").isNotNull())
    weighed = F.sum(F.when(picked, F.col("_b") * F.col("net"))) / F.sum(F.when(picked, F.col("_b")))
    mine = F.when((known == n) & (F.sum(F.when(picked, F.col("_b"))) > 0), weighed).otherwise(F.sum(F.when(picked, F.col("net"))) / n)
    g = ranked.groupBy("date").agg(mine.alias("net"), n.alias("n"), F.avg(F.when(cheapest, F.col("net"))).alias("cost_sort_net"), F.avg("net").alias("pool_net"))
    days = cal.select("date").join(g, "date", "left")
    days = days.withColumn("abstain", F.coalesce(F.col("n"), F.lit(0)) < k).withColumn("net", F.when(F.coalesce(F.col("n"), F.lit(0)) >= k, F.col("net")))
    past = W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-gate_rows, -1)
    return days.withColumn("gate", F.coalesce(F.avg("net").over(past) > 0, F.lit(True))).drop("n")


def position_size(picks: DataFrame, capital: float, most_share: float = 0.4) -> DataFrame:
    """Whole shares for a weight of the capital, and a limit price on the tick grid."""
    at = F.col("close_raw"), F.col("market"), F.col("date")
    tick = M.tick_size(*at)
    budget = capital * F.when(F.col("weight").isNotNull(), F.least(F.col("weight"), F.lit(most_share)))
    return picks.withColumn("qty", F.floor(budget / F.col("close_raw")).cast("long")).withColumn("limit_price", F.floor((F.col("close_raw") + tick) / tick) * tick)


def screen_grid(panel: DataFrame, grid: DataFrame) -> DataFrame:
    """By screen of the grid (name, low, high, value, cap): rows, days, mean net; best first."""
    keep = (F.col("chg_ratio") >= F.col("s_low")) & (F.col("chg_ratio") < F.col("s_high")) & (F.col("tv_clean") >= F.col("s_value")) & (F.col("mc_clean") >= F.col("s_cap"))
    named = grid.select("name", *(F.col(c).alias(f"s_{c}") for c in ("low", "high", "value", "cap")))
    daily = panel.crossJoin(F.broadcast(named)).where(keep).groupBy("name", "date").agg(F.avg("net").alias("net"), F.count("*").alias("n"))
    out = daily.groupBy("name").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_days"), F.avg("net").alias("mean_net"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("mean_net"), "name")).cast("long"))


def rank_pool(pool: DataFrame, k: int, order: Sequence[Column], names: DataFrame) -> DataFrame:
    """The ranked pool, with names and `selected`."""
    r = pool.withColumn("rank", F.row_number().over(W.partitionBy("date").orderBy(*order, "symbol")).cast("long"))
    return r.withColumn("selected", F.col("rank") <= k).join(names, "symbol", "left")


# Costs, labels, exits


def row_costs(rows: DataFrame, impact: DataFrame, fallback_bp: float = 5.0, ticks: float = 2.0) -> DataFrame:
    """L4: components of a row's cost; `measured` where the impact was."""
    at = F.col("close_raw"), F.col("market"), F.col("date")
    j = rows.join(impact.select("date", "symbol", "impact_bp"), ["date", "symbol"], "left")
    used = F.coalesce(F.abs("impact_bp"), F.lit(fallback_bp))
    return j.withColumn("tax_part", M.tax_bp(F.col("date"))).withColumn("tick_part", ticks * M.tick_cost_bp(*at)).withColumn("impact_part", used).withColumn("measured", F.col("impact_bp").isNotNull()).withColumn("cost_bp", F.col("tax_part") + F.col("tick_part") + used + M.FEE_BP)


def cost_summary(costs: DataFrame, gross: str = "gross", least_days: int = 30) -> DataFrame:
    """Means of daily means of the components and the gross that breaks even; NULL with few days."""
    daily = costs.groupBy("date").agg(*(F.avg(c).alias(c) for c in ("tax_part", "tick_part", "impact_part", "cost_bp", gross)), F.avg(F.col("measured").cast("double")).alias("measured"))
    out = daily.agg(F.count("*").alias("n_days"), *(F.avg(c).alias(c) for c in ("tax_part", "tick_part", "impact_part", "cost_bp", "measured")), F.avg(gross).alias("_g"))
    return out.withColumn("break_even_bp", F.when(F.col("n_days") >= least_days, F.col("_g") * 1e4 - F.col("cost_bp"))).drop("_g")


def forward_exit(rows: DataFrame, panel: DataFrame, cal: DataFrame, ahead: int = 20, haircut: float = M.HAIRCUT) -> DataFrame:
    """The first session of the next `ahead` with a tradable open.

    The sessions ahead join by position as one equi join per symbol and a range
    of positions, and the first is taken by min_by; there is no join per
    session. Without the next session in the calendar the price is NULL.
    """
    pos = F.broadcast(cal.select("date", F.col("pos").alias("_pos")))
    last = F.broadcast(cal.agg(F.max("pos").alias("_last")))
    tradable = panel.where("open > 0 and volume > 0").join(pos, "date").select(F.col("symbol").alias("_s"), F.col("_pos").alias("_p"), F.col("open").alias("_o"))
    left = rows.select("date", "symbol", "close").join(pos, "date")
    step = left.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("_bucket", F.floor(F.col("_pos") / ahead) + F.col("_slot"))
    right = tradable.withColumn("_bucket", F.floor(F.col("_p") / ahead))
    j = step.join(right, (step["symbol"] == right["_s"]) & (step["_bucket"] == right["_bucket"]) & (F.col("_p") > F.col("_pos")) & (F.col("_p") <= F.col("_pos") + ahead), "left")
    found = j.groupBy("date", "symbol").agg(F.first("close").alias("close"), F.first("_pos").alias("_pos"), F.min("_p").alias("_p"), F.min_by("_o", "_p").alias("_o")).crossJoin(last)
    has_next = F.col("_pos") + 1 <= F.col("_last")
    days = F.when(~has_next, 1).when(F.col("_p").isNull(), ahead).otherwise(F.col("_p") - F.col("_pos"))
    status = F.when(~has_next | (F.col("_p") == F.col("_pos") + 1), "EXIT_TRADABLE").when(F.col("_p").isNull(), "UNRESOLVED_EXIT").otherwise("EXIT_SUSPENDED")
    price = F.when(has_next, F.coalesce("_o", F.col("close") * haircut))
    out = found.withColumn("holding_days", days.cast("int")).withColumn("status", status).withColumn("exit_price", price).withColumn("_at", F.col("_pos") + F.col("holding_days"))
    return out.join(F.broadcast(cal.select(F.col("date").alias("exit_date"), F.col("pos").alias("_at"))), "_at", "left").select("date", "symbol", "exit_price", "status", "holding_days", "exit_date")


def label(rows: DataFrame, net: str = "net", limit: float = 0.3) -> DataFrame:
    """The clipped net and the same less its mean of the date."""
    y = F.when(F.col(net).isNotNull(), F.least(F.greatest(F.col(net), F.lit(-limit)), F.lit(limit)))
    return rows.withColumn("y", y).withColumn("y_demeaned", F.col("y") - F.avg("y").over(W.partitionBy("date")))


def multi_targets(rows: DataFrame, net: str = "net") -> DataFrame:
    """Clipped return, grade 0..4 within the date (2 for a lone row; spread over the grades for few), flags."""
    known = label(rows.where(F.col(net).isNotNull()), net)
    w = W.partitionBy("date")
    rank = F.row_number().over(w.orderBy(net, "symbol"))
    n = F.count("*").over(w)
    few = F.bround((rank - 1) / (n - 1) * 4)
    quint = F.ceil(((rank - 1) / (n - 1)) * 5) - 1
    grade = F.when(n == 1, 2).when(n < 5, few).otherwise(F.greatest(quint, F.lit(0)))
    return known.withColumn("grade", grade.cast("int")).withColumn("good", (F.col(net) > 0.01).cast("int")).withColumn("bad", (F.col(net) < -0.01).cast("int"))


def mechanical_label(panel: DataFrame) -> DataFrame:
    """Next row's open over the close, with flags."""
    w = W.partitionBy("symbol").orderBy("date")
    g = F.lead("open").over(w) / F.col("close") - 1
    return panel.withColumn("gross", g).withColumn("label_known", F.col("gross").isNotNull()).withColumn("up_label", (F.col("gross") > 0).cast("int"))


def take_profit(rows: DataFrame, target: Column, haircut: float = 0.0, at_close: bool = True, fill: float = 1.0, seed: int = 1) -> DataFrame:
    """Exit price: the open if it gaps over the target, the target less a haircut if touched, else close or open."""
    limit = F.col("entry") * (1 + target)
    draw = F.pmod(F.xxhash64("date", "symbol", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    touched = (F.col("next_high") >= limit) & (F.lit(True) if fill >= 1 else draw < fill)
    other = F.col("next_close") if at_close else F.col("next_open")
    price = F.when(F.col("next_open").isNull(), None).when(F.col("next_open") >= limit, F.col("next_open")).when(touched, limit * (1 - haircut)).otherwise(other)
    return rows.withColumn("exit_price", price).withColumn("touched", F.coalesce(F.col("next_high") >= limit, F.lit(False)))


def exit_grid(picks: DataFrame, targets: DataFrame, locked: float = 0.28) -> DataFrame:
    """By target: mean return of the first pick of each date and what it adds to the next open."""
    first = top_k(picks.where(F.abs("chg_ratio") < locked), 1, [F.col("chg_ratio").desc()])
    rows = take_profit(first.crossJoin(F.broadcast(targets)), F.col("target"))
    ret = F.col("exit_price") / F.col("entry") - 1
    base = F.col("next_open") / F.col("entry") - 1
    return rows.groupBy("target").agg(F.count("exit_price").alias("n"), F.avg(ret).alias("mean_ret"), F.avg(ret - base).alias("delta"), F.avg(F.col("touched").cast("double")).alias("touch_rate"))


PARTICIPATION_CAP = 0.10  # fixed value: the share of the auction that an order may take
CEILING_RATIO = 1.29  # fixed value: close over previous close that counts as the daily limit


def ceiling_entry() -> Column:
    """A close at the day's high and at the limit of the previous close."""
    ratio = F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close"))
    return F.coalesce((ratio >= CEILING_RATIO) & (F.col("close") >= F.col("high")), F.lit(False))


def buyability(rows: DataFrame, liquidity: DataFrame, order_value: float, participation: float = PARTICIPATION_CAP, least_fill: float = 1.0, require_data: bool = False) -> DataFrame:
    """What share of an order the closing auction could fill; no row is dropped.

    liquidity: date, symbol, auction_value of measured rows. The share is
    participation * auction_value / order_value, between 0 and 1, NULL if
    unknown. A measured row is buyable from `least_fill` on (a NULL value isn't);
    a row that wasn't measured is buyable unless data are required.
    """
    if not (order_value > 0 and order_value != float("inf")) or not 0 < participation <= 1:
        raise ValueError("order_value must be finite and above 0, participation above 0 and at most 1")
    found = liquidity.select("date", "symbol", "auction_value", F.lit(True).alias("_found"))
    j = rows.join(found, ["date", "symbol"], "left").withColumn("auction_found", F.coalesce("_found", F.lit(False))).drop("_found")
    j = j.withColumn("fill_ratio", clip(F.col("auction_value") * participation / order_value, 0.0, 1.0))
    buyable = F.when(~F.col("auction_found"), F.lit(not require_data)).otherwise(F.coalesce(F.col("fill_ratio") >= least_fill, F.lit(False)))
    return j.withColumn("ceiling_entry", ceiling_entry()).withColumn("buyable", buyable)


def buyability_report(rows: DataFrame) -> DataFrame:
    """Counts of a gated table, and the median and lower quartile of the auction values that were blocked."""
    blocked = F.when(~F.col("buyable"), F.col("auction_value"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if("ceiling_entry").alias("n_ceiling"),
        F.count_if(~F.col("auction_found")).alias("n_unmeasured"),
        F.count_if(~F.col("buyable")).alias("n_blocked"),
        F.percentile(blocked, F.lit(0.5)).alias("blocked_median"),
        F.percentile(blocked, F.lit(0.25)).alias("blocked_p25"),
    )


def labels_for_keys(keys: DataFrame, exits: DataFrame, costs: DataFrame) -> DataFrame:
    """Net of arbitrary keys."""
    j = keys.join(exits, ["date", "symbol"], "left").join(costs.select("date", "symbol", "close", "cost_bp"), ["date", "symbol"], "left")
    return j.withColumn("net", F.col("exit_price") / F.col("close") - 1 - F.col("cost_bp") / 1e4)
