"""Features of names and days, all from rows known at the decision."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions import market as M
from tapewright.functions.checks import ContractError, unique
from tapewright.functions.windows import by_symbol, clip, pct_rank_avg, trailing, with_extremes
from tapewright.operators.calendar import asof_join
from tapewright.sources.stores import removed, shared_path, shuffles_removed

UP = 0.05


def cross_section(panel: DataFrame) -> DataFrame:
    """shape of the day's bar, log sizes, average percent ranks by date."""
    rng = F.when((F.col("high") - F.col("low")).isNotNull(), F.greatest(F.col("high") - F.col("low"), F.lit(1.0)))
    top = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.greatest("open", "close"))
    log = lambda c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0))))
    return (
        panel.withColumn("f_body", (F.col("close") - F.col("open")) / rng)
        .withColumn("f_upper", (F.col("high") - top) / rng)
        .withColumn("f_range", (F.col("high") - F.col("low")) / F.col("close"))
        .withColumn("f_log_tv", log("tv_clean"))
        .withColumn("f_log_mc", log("mc_clean"))
        .withColumn("f_rank_tv", pct_rank_avg(F.col("tv_clean")))
        .withColumn("f_rank_chg", pct_rank_avg(F.col("chg_ratio")))
    )


def history(panel: DataFrame, up: float = UP) -> DataFrame:
    """twelve features of earlier rows; each window ends on the row before, f_gap and f_dist_high60 are of the row."""
    w = by_symbol()
    r = F.col("chg_ratio")
    p = panel.withColumn("_lr", F.log1p(r)).withColumn("_gap", F.when((F.col("open") > 0) & (F.col("prev_close") > 0), F.col("open") / F.col("prev_close") - 1))
    p = p.withColumn("_idx", F.when(F.col("_lr").isNotNull(), F.sum("_lr").over(w.rowsBetween(W.unboundedPreceding, 0))))
    p = p.withColumn("_after_up", F.when(r >= up, F.lead("_gap").over(w))).withColumn("_id", F.when(F.col("open") > 0, F.col("close") / F.col("open") - 1))
    p = p.withColumn("_amount", F.exp("_idx") * F.col("volume")).withColumn("_up", (F.coalesce(r >= up, F.lit(False))).cast("double"))
    roll = lambda c, n, f: trailing(F.col(c), n, f, max(3, n // 2))
    high = F.when(F.count("_idx").over(w.rowsBetween(-59, 0)) >= 20, F.max("_idx").over(w.rowsBetween(-59, 0)))
    den = F.nullif(roll("_amount", 5, F.sum), F.lit(0.0))
    out = (
        p.withColumn("f_ret5", roll("_lr", 5, F.sum))
        .withColumn("f_ret20", roll("_lr", 20, F.sum))
        .withColumn("f_ret60", roll("_lr", 60, F.sum))
        .withColumn("f_dist_high60", F.expm1(F.col("_idx") - high))
        .withColumn("f_upcount20", F.when(F.row_number().over(w) >= 10, F.sum("_up").over(w.rowsBetween(-20, -1))))
        .withColumn("f_on_mean20", roll("_gap", 20, F.avg))
        .withColumn("f_on_mean60", roll("_gap", 60, F.avg))
        .withColumn("f_gap", F.col("_gap"))
        .withColumn("f_upnext_on60", trailing(F.col("_after_up"), 60, F.avg, 3))
        .withColumn("f_id_mean20", roll("_id", 20, F.avg))
        .withColumn("f_inst_cum5", clip(roll("inst_netbuy", 5, F.sum) / den, -1, 1))
        .withColumn("f_foreign_cum5", clip(roll("foreign_netbuy", 5, F.sum) / den, -1, 1))
    )
    return out.drop("_lr", "_gap", "_idx", "_after_up", "_id", "_amount", "_up")


def restricted(panel: DataFrame, keys: DataFrame, lookback: int = 120) -> DataFrame:
    """history features at the requested keys only.

    Rows are cut to the asked symbols, and to the rows that windows can reach,
    before the window; the semi join after it can't be pushed below.
    """
    symbols = keys.groupBy("symbol").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    near = panel.join(symbols, "symbol").where("date <= _to").drop("_from", "_to")
    return history(near).join(keys.select("date", "symbol").distinct(), ["date", "symbol"], "left_semi")


def lagged_flow_density(panel: DataFrame) -> DataFrame:
    """the flow of the strictly earlier row over its amount, in [-1, 1], and its average rank by date."""
    j = asof_join(panel, panel.select("symbol", "date", "inst_netbuy", F.col("tv_clean").alias("amount")), ["inst_netbuy", "amount"])
    density = clip(F.coalesce("inst_netbuy_asof", F.lit(0.0)) / F.greatest(F.coalesce("amount_asof", F.lit(1.0)), F.lit(1.0)), -1, 1)
    return j.withColumn("f_flow_density", density).withColumn("f_flow_rank", pct_rank_avg(F.col("inst_netbuy_asof")))


def cost_features(panel: DataFrame) -> DataFrame:
    """F5"""
    return panel.withColumn("f_tick_cost", F.col("tick_cost_bp")).withColumn("f_log_price", F.when(F.col("close_raw") > 0, F.log("close_raw")))


LEAST = {5: 3, 10: 5, 14: 7, 20: 10, 60: 30, 252: 60}


def trailing_features(panel: DataFrame) -> DataFrame:
    """sixteen features of rows up to and with the current one; returns are close to close."""
    w = by_symbol()
    roll = lambda c, n, f: trailing(F.col(c) if isinstance(c, str) else c, n, f, LEAST[n], lag=0)
    p = panel.withColumn("_pc", F.lag("close").over(w))
    p = p.withColumn("_r", F.col("close") / F.col("_pc") - 1).withColumn("_gap", F.col("open") / F.col("_pc") - 1)
    p = p.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))))
    p = p.withColumn("_illiq", F.abs("_r") / F.nullif("tv_clean", F.lit(0.0))).withColumn("_upday", (F.coalesce(F.col("_r") > 0, F.lit(False))).cast("double"))
    flow_mean, flow_std = roll("inst_netbuy", 20, F.avg), roll("inst_netbuy", 20, F.stddev)
    out = with_extremes(p, {"_high": ("high", F.greatest), "_low": ("low", F.least)}, 252, LEAST[252])
    for n in (5, 20, 60):
        out = out.withColumn(f"t_ret{n}", F.col("close") / F.lag("close", n).over(w) - 1)
    return (
        out.withColumn("t_ma5", F.col("close") / roll("close", 5, F.avg) - 1)
        .withColumn("t_ma20", F.col("close") / roll("close", 20, F.avg) - 1)
        .withColumn("t_ma60", F.col("close") / roll("close", 60, F.avg) - 1)
        .withColumn("t_vol20", roll("_r", 20, F.stddev))
        .withColumn("t_vol60", roll("_r", 60, F.stddev))
        .withColumn("t_atr14", roll("_tr", 14, F.avg) / F.col("close"))
        .withColumn("t_high252", F.col("close") / F.col("_high") - 1)
        .withColumn("t_low252", F.col("close") / F.col("_low") - 1)
        .withColumn("t_volume_ratio", F.col("volume") / F.nullif(roll("volume", 20, F.avg), F.lit(0.0)))
        .withColumn("t_amihud20", roll("_illiq", 20, F.avg))
        .withColumn("t_flow_z", clip((F.col("inst_netbuy") - flow_mean) / F.nullif(flow_std, F.lit(0.0)), -5, 5))
        .withColumn("t_up_ratio", roll("_upday", 20, F.avg))
        .withColumn("t_gap_mean", roll("_gap", 20, F.avg))
        .drop("_pc", "_r", "_gap", "_tr", "_illiq", "_upday", "_high", "_low")
    )


def attach_trailing(rows: DataFrame, features: DataFrame, names: Sequence[str], floor: float = 0.005, fallback: float = 0.03) -> DataFrame:
    """trailing features of the strictly earlier row; the volatility has a floor and a fallback."""
    j = asof_join(rows, features, names)
    vol = F.col("t_vol20_asof")
    return j.withColumn("vol_used", F.when(vol.isNull(), fallback).otherwise(F.greatest(vol, F.lit(floor))))


def core_history(panel: DataFrame) -> DataFrame:
    """F8: 20-row illiquidity and turnover, a row later."""
    p = panel.withColumn("_i", F.abs("chg_ratio") / F.greatest(F.col("tv_clean"), F.lit(1e-6))).withColumn("_t", F.col("tv_clean") / F.nullif("mc_clean", F.lit(0.0)))
    return p.withColumn("h_amihud20", trailing(F.col("_i"), 20, F.avg, 10)).withColumn("h_turnover20", trailing(F.col("_t"), 20, F.avg, 10)).drop("_i", "_t")


def extended_history(panel: DataFrame) -> DataFrame:
    """seven features, each of rows before the current one."""
    p = panel.withColumn("_rng", (F.col("high") - F.col("low")) / F.nullif("close", F.lit(0.0))).withColumn("_pd", F.col("program_netbuy") / F.nullif("volume", F.lit(0.0)))
    r = F.col("chg_ratio")
    return (
        p.withColumn("e_vol20", trailing(r, 20, F.stddev, 10))
        .withColumn("e_skew20", trailing(r, 20, F.skewness, 10))
        .withColumn("e_max20", trailing(r, 20, F.max, 10))
        .withColumn("e_min20", trailing(r, 20, F.min, 10))
        .withColumn("e_range20", trailing(F.col("_rng"), 20, F.avg, 10))
        .withColumn("e_program5", trailing(F.col("_pd"), 5, F.avg, 3))
        .withColumn("e_tv_growth", F.log1p(trailing(F.col("tv_clean"), 5, F.avg, 3)) - F.log1p(trailing(F.col("tv_clean"), 60, F.avg, 30)))
        .drop("_rng", "_pd")
    )


def market_state(panel: DataFrame) -> DataFrame:
    """breadth, cap- and equal-weight change and dispersion of a date."""
    r, cap = F.col("chg_ratio"), F.when(F.col("chg_ratio").isNotNull(), F.col("mc_clean"))
    return panel.groupBy("date").agg(
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("m_breadth"), (F.sum(r * cap) / F.nullif(F.sum(cap), F.lit(0.0))).alias("m_cap_chg"), F.avg(r).alias("m_equal_chg"), F.stddev(r).alias("m_dispersion")
    )


def index_features(index: DataFrame) -> DataFrame:
    """on a table of dates: level against its 20-day mean, board difference, 60-day z, calendar."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    last20, last60 = w.rowsBetween(-19, 0), w.rowsBetween(-59, 0)
    diff = F.col("kospi_pct") - F.col("kosdaq_pct")
    rows = index.withColumn("i_diff", diff)
    z = (F.col("kospi_pct") - F.avg("kospi_pct").over(last60)) / F.nullif(F.stddev("kospi_pct").over(last60), F.lit(0.0))
    second_thursday = (F.dayofweek("date") == 5) & F.dayofmonth("date").between(8, 14)
    return (
        rows.withColumn("i_ma20", F.when(F.count("kospi_level").over(last20) >= 10, F.col("kospi_level") / F.avg("kospi_level").over(last20) - 1))
        .withColumn("i_z60", F.when(F.count("kospi_pct").over(last60) >= 30, z))
        .withColumn("i_gap_days", F.datediff("date", F.lag("date").over(w)))
        .withColumn("i_weekday", F.weekday("date"))
        .withColumn("i_expiry", second_thursday)
    )


def robust_z(rows: DataFrame, value: str, by: str = "date", limit: float = 5.0) -> DataFrame:
    """(x - median) / MAD by date; a MAD of 0 gives NULL; clipped."""
    middle = F.percentile(value, F.lit(0.5)).over(W.partitionBy(by))
    dev = rows.withColumn("_d", F.col(value) - middle)
    mad = F.percentile(F.abs("_d"), F.lit(0.5)).over(W.partitionBy(by))
    return dev.withColumn(f"{value}_rz", clip(F.col("_d") / F.nullif(mad, F.lit(0.0)), -limit, limit)).drop("_d")


# Columns that get a percent rank by date, a log and a signed log.
RANKED = {"trade_value_100m": "trade_value_pct_rank", "inst_net_buy": "inst_net_buy_pct_rank", "foreign_net_buy": "foreign_net_buy_pct_rank", "change_rate": "change_rate_pct_rank", "major_density": "major_density_pct_rank", "prog_dominance": "prog_dominance_pct_rank", "gap_ratio": "gap_ratio_pct_rank", "turnover": "turnover_pct_rank"}
LOGGED = ("market_cap_100m", "trade_value_100m", "volume", "avg_trade_value")
SIGNED_LOG = ("inst_net_buy", "foreign_net_buy", "prog_net_buy")
WEEKDAYS = ("weekday_is_monday", "weekday_is_tuesday", "weekday_is_wednesday", "weekday_is_thursday", "weekday_is_friday")


def daily_references(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """trade_date and for each column the date's number that its rows carry, 0 as unknown, filled forward, then backward, and its change; 0 where there is none."""
    known = lambda c: F.nullif(c, F.lit(0.0))
    daily = rows.groupBy("trade_date").agg(*(F.min_by(known(c), F.when(known(c).isNotNull(), F.col("stock_code"))).alias(f"_{c}") for c in columns))
    w = W.partitionBy(F.lit(1)).orderBy("trade_date")  # a row for each date
    for c in columns:
        filled = F.coalesce(F.last(f"_{c}", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(f"_{c}", True).over(w.rowsBetween(0, W.unboundedFollowing)))
        daily = daily.withColumn(c, filled).withColumn(f"{c}_change", F.coalesce(F.col(c) / F.lag(c).over(w) - 1, F.lit(0.0))).drop(f"_{c}")
    return daily


def snapshot_block(rows: DataFrame) -> DataFrame:
    """ratios in per cent, candle shapes, densities, relative changes, logs, ranks, interactions, weekdays and flow agreement of a snapshot.

    rows: trade_date, stock_code, market_type, theme_sector, prices (open_price,
    high_price, low_price, close_price, prev_close_price, buy_price), change_rate,
    trade_value_100m, market_cap_100m, volume, avg_trade_value, the net buys,
    selection_rank, total_candidate_count, kospi_change, kosdaq_change, v_kospi,
    v_kosdaq. Net buys are given back as signed logs. Unknown numbers stay NULL
    but for net buys in densities and in the agreement of flows, where they are 0.
    """
    c, zero = F.col, F.lit(0.0)
    at_least = lambda x, low: F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    prev, value = F.nullif(c("prev_close_price"), zero), F.nullif(c("trade_value_100m"), zero)
    span = at_least(c("high_price") - c("low_price"), 1.0)
    top = F.when(c("open_price").isNotNull() & c("close_price").isNotNull(), F.greatest("open_price", "close_price"))
    inst, foreign = F.coalesce("inst_net_buy", zero), F.coalesce("foreign_net_buy", zero)
    out = rows.withColumns(
        {
            "buy_price_change_rate": (c("buy_price") - c("prev_close_price")) / prev * 100,
            "gap_ratio": (c("open_price") - c("prev_close_price")) / prev * 100,
            "intraday_return": (c("close_price") - c("open_price")) / F.nullif(c("open_price"), zero),
            "intraday_range": (c("high_price") - c("low_price")) / prev * 100,
            "close_position": (c("close_price") - c("low_price")) / span,
            "upper_shadow_ratio": (c("high_price") - top) / span,
            "body_ratio": F.abs(c("close_price") - c("open_price")) / span,
            "turnover": c("trade_value_100m") / at_least(c("market_cap_100m"), 0.01),
            "inst_density": inst / value,
            "foreign_density": foreign / value,
            "major_density": (inst + foreign) / value,
            "prog_dominance": c("prog_net_buy") / value,
            "rank_ratio": c("selection_rank") / F.greatest(F.coalesce("total_candidate_count", F.lit(1)), F.lit(1)),
            "relative_change_kospi": c("change_rate") - c("kospi_change"),
            "relative_change_kosdaq": c("change_rate") - c("kosdaq_change"),
            "sector_relative_change": F.when(c("theme_sector").isNotNull(), c("change_rate") - F.avg("change_rate").over(W.partitionBy("trade_date", "theme_sector"))),
        }
    )
    of_market = F.when(F.upper("market_type").contains("KOSDAQ"), c("kosdaq_change")).otherwise(c("kospi_change"))
    out = out.withColumn("relative_change_rate", c("buy_price_change_rate") - of_market)
    out = out.drop("v_kospi", "v_kosdaq").join(daily_references(rows, ("v_kospi", "v_kosdaq")), "trade_date")
    out = out.withColumns({f"log_{n}": F.log1p(at_least(c(n), 0.0)) for n in LOGGED})
    out = out.withColumns({n: F.signum(n) * F.log1p(F.abs(n)) for n in SIGNED_LOG})
    out = out.withColumns({to: pct_rank_avg(c(n), ("trade_date",)) for n, to in RANKED.items()})
    flows = [F.coalesce(n, zero) for n in ("inst_density", "foreign_density", "prog_dominance")]
    in_all = F.abs(flows[0]) + F.abs(flows[1]) + F.abs(flows[2])
    out = out.withColumns(
        {
            "candle_strength": clip((2 * c("close_position") - 1) * c("body_ratio") * c("intraday_range"), -5, 5),
            "range_efficiency": clip(F.abs("intraday_return") / at_least(c("intraday_range") / 100, 1e-6), 0, 5),
            "flow_turnover": clip(c("major_density") * c("turnover"), 0, 5),
            "relative_flow_strength": clip(c("major_density_pct_rank") * c("change_rate_pct_rank"), 0, 1),
            **{n: (F.weekday("trade_date") == k).cast("double") for k, n in enumerate(WEEKDAYS)},
            "flow_consensus": F.signum(flows[0]) + F.signum(flows[1]) + F.signum(flows[2]),
            "flow_alignment_direction": F.when(in_all != 0, (flows[0] + flows[1] + flows[2]) / in_all).otherwise(0.0),
        }
    )
    return out.withColumn("friday_selection_rank_pct", c("weekday_is_friday") * (1 - c("rank_ratio")))


def fill_by_date(daily: DataFrame, value: str) -> DataFrame:
    """on a table of dates: 0 is missing, filled forward, then backward; and its change."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    v = F.nullif(value, F.lit(0.0))
    d = daily.withColumn("_v", v)
    filled = F.coalesce(F.last("_v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("_v", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return d.withColumn(value, filled).withColumn(f"{value}_chg", F.col(value) / F.lag(value).over(w) - 1).drop("_v")


def window_returns(panel: DataFrame, year: int, days: int = 550) -> DataFrame:
    """date, symbol, r: log returns in the days before a year's first."""
    first = F.lit(f"{year}-01-01").cast("date")
    return panel.where((F.col("date") < first) & (F.col("date") >= F.date_sub(first, days))).where("close > 0 and prev_close > 0").select("date", "symbol", F.log(F.col("close") / F.col("prev_close")).alias("r"))


#: Names of a block of the matrix of correlations; a step of a task holds two blocks' returns.
BLOCK_NAMES = 512


def return_blocks(r: DataFrame) -> tuple[DataFrame, int]:
    """(block, names: each with its symbol, days and returns), and how many blocks there are: names dealt by hash, some BLOCK_NAMES together."""
    r = r.where("symbol is not null")
    blocks = max(1, -(-r.select("symbol").distinct().count() // BLOCK_NAMES))
    lists = r.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), "r"))).alias("h"))  # a name's days
    name = F.struct("symbol", F.col("h.day").alias("days"), F.col("h.r").alias("returns"))
    return lists.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(name).alias("names")), blocks


def block_pairs(packed: DataFrame, blocks: int) -> DataFrame:
    """i, left, j, right: each two blocks once, as a Cartesian product: a task reads two groups of at most 16 or so blocks, and nothing but the blocks themselves is ever stored."""
    groups = min(blocks, max(-(-blocks // 16), math.isqrt(4 * packed.sparkSession.sparkContext.defaultParallelism) + 1))
    dealt = packed.repartition(groups)
    left, right = dealt.select(F.col("block").alias("i"), F.col("names").alias("left")), dealt.select(F.col("block").alias("j"), F.col("names").alias("right"))
    return left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """i, j and the two lists of names of each row of `block_pairs`."""
    for batch in batches:
        for i, j, left, right in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["left"], batch["right"], strict=True):
            yield i, j, left.values, right.values


def _correlations(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Common dates and correlations (NaN: none) of the names of two blocks, by products of matrices."""
    sides = [(len(x), pc.list_value_length(x.field("days")).to_numpy(), x.field("days").flatten().to_numpy(), x.field("returns").flatten().to_numpy(zero_copy_only=False)) for x in (left, right)]
    days = np.union1d(sides[0][2], sides[1][2])
    filled = []
    for names, lengths, at, r in sides:
        there, x, row = np.zeros((names, len(days))), np.zeros((names, len(days))), np.repeat(np.arange(names), lengths)
        cell = row, np.searchsorted(days, at)
        there[cell], x[cell] = 1, r - (np.bincount(row, r, names) / np.maximum(lengths, 1))[row]  # a shift changes no correlation
        filled += [there, x]
    m, u, w, v = filled[0], filled[1], filled[2].T, filled[3].T
    n, sa, sb, qa, qb = m @ w, u @ w, m @ v, u**2 @ w, m @ v**2
    va, vb = n * qa - sa**2, n * qb - sb**2
    some = (n > 1) & (va > 1e-12 * n * qa) & (vb > 1e-12 * n * qb)
    return n, np.where(some, (n * (u @ v) - sa * sb) / np.sqrt(np.where(some, va * vb, 1.0)), np.nan)


def return_correlations(r: DataFrame, least: int = 1) -> DataFrame:
    """a, b, n, corr for each pair of names with `least` common dates.

    Returns are shuffled in proportion to their rows; two blocks of names meet
    in a Cartesian product, whose work alone grows with the square of the names.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, left, right in _sides(batches):
            n, corr = _correlations(left, right)
            names = pa.chunked_array([left.field("symbol"), right.field("symbol")]).combine_chunks()
            place = np.empty(len(names), int)
            place[np.argsort(names.to_numpy(zero_copy_only=False).astype(object), kind="stable")] = np.arange(len(names))
            met = n >= max(least, 1)
            if i == j:
                met &= place[: len(left), None] < place[None, : len(left)]
            p, q = np.nonzero(met)
            one, two, value = p, q + len(left), corr[p, q]
            first = place[one] < place[two]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.where(first, one, two))), names.take(pa.array(np.where(first, two, one))), pa.array(n[p, q].astype(np.int64)), pa.array(value, mask=np.isnan(value))], ["a", "b", "n", "corr"])

    return block_pairs(*return_blocks(r)).mapInArrow(pairs, "a string, b string, n long, corr double")


def pair_correlations(panel: DataFrame, year: int, days: int = 550, least: int = 120) -> DataFrame:
    """correlations of log returns in the days before a year's first, for pairs with enough common dates."""
    return return_correlations(window_returns(panel, year, days), least)


def correlation_rows(r: DataFrame, names: DataFrame) -> DataFrame:
    """symbol, features: each name's correlations with all names, in their order; 1 with itself, 0 where there is none."""
    from pyspark.ml.functions import array_to_vector

    placed = names.select("symbol", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("symbol")) - 1).alias("at"))  # a row for each name
    c = return_correlations(r.join(names.select("symbol"), "symbol", "left_semi")).where("corr is not null and not isnan(corr)").select("a", "b", "corr")
    own = names.select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(1.0).alias("corr"))
    whole = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionByName(own)
    found = whole.join(placed.withColumnRenamed("symbol", "b"), "b").groupBy(F.col("a").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct("at", "corr"))).alias("_h"))
    # Zeros fill the places between a found one and the one before it, and those after the last.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_h"), i - 1)["at"])
    filled = F.flatten(F.transform("_h", lambda x, i: F.concat(F.array_repeat(F.lit(0.0), x["at"] - before(i) - 1), F.array(x["corr"]))))
    after = F.array_repeat(F.lit(0.0), F.lit(names.count() - 1) - F.element_at("_h", -1)["at"])
    return found.select("symbol", array_to_vector(F.concat(filled, after)).alias("features"))


#: Bytes of a year's correlations that clusters keep on disk while they are fitted; four years are at work at once.
KEPT_BYTES = 512 << 20

Tiles = Iterator[tuple[int, int, np.ndarray]]


def _made_tiles(batches: Iterator[pa.RecordBatch]) -> Tiles:
    """Blocks of the matrix of correlations: 1 with itself, 0 where there is none."""
    for i, j, left, right in _sides(batches):
        c = np.nan_to_num(_correlations(left, right)[1])
        if i == j:
            np.fill_diagonal(c, 1.0)
        yield i, j, c


def _kept_tiles(batches: Iterator[pa.RecordBatch]) -> Tiles:
    for batch in batches:
        for i, j, rows, c in zip(batch["i"].to_pylist(), batch["j"].to_pylist(), batch["rows"].to_pylist(), batch["c"], strict=True):
            yield i, j, np.frombuffer(c.as_buffer()).reshape(rows, -1)


def _store_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, j, c in _made_tiles(batches):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([len(c)], pa.int32()), pa.array([c.tobytes()])], ["i", "j", "rows", "c"])


class CorrelationMatrix:
    """The correlations of all names, by blocks: as many as `kept_bytes` hold are kept in `path`, the others are made anew in each pass.

    What is kept grows with the square of the names up to that bound; else only
    blocks of returns are on disk, and two numbers of each name on the driver.
    """

    def __init__(self, r: DataFrame, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        self.spark = r.sparkSession
        packed, self.blocks = return_blocks(r)
        packed.write.parquet(f"{path}/returns")
        self.packed = self.spark.read.parquet(f"{path}/returns")
        listed = {row.block: row.s for row in self.packed.select("block", F.col("names.symbol").alias("s")).collect()}
        self.symbols = sorted(s for names in listed.values() for s in names)
        at = {s: n for n, s in enumerate(self.symbols)}
        self.place = {block: np.array([at[s] for s in names]) for block, names in listed.items()}
        share = kept_bytes / (4 * len(at) * (len(at) + BLOCK_NAMES) or 1)
        is_kept = F.pmod(F.xxhash64("i", "j"), F.lit(1000)) < min(int(1000 * share), 1000)
        self.parts = []
        if share >= 0.001:
            block_pairs(self.packed, self.blocks).where(is_kept).mapInArrow(_store_tiles, "i int, j int, rows int, c binary").write.parquet(f"{path}/tiles")
            self.parts.append((lambda: self.spark.read.parquet(f"{path}/tiles"), _kept_tiles))
        if share < 1:
            self.parts.append((lambda: block_pairs(self.packed, self.blocks).where(~is_kept), _made_tiles))

    def times(self, values: np.ndarray, squares: bool = False) -> np.ndarray:
        """The matrix times `values` (a row for each name in order), and with `squares` the sum of squares of each of its rows as a last column."""
        columns = [f"p{c}" for c in range(values.shape[1] + squares)]
        needed = [block for block, rows in self.place.items() if squares or values[rows].any()]
        sent = self.spark.sparkContext.broadcast((self.place, values))

        def products(tiles: Callable[..., Tiles]) -> Callable[..., Iterator[pa.RecordBatch]]:
            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                (rows, given), sums = sent.value, {}
                for i, j, c in tiles(batches):
                    for at, part, other in ((i, c, j), (j, c.T, i)) if i != j else ((i, c, i),):
                        one = part @ given[rows[other]]
                        one = np.column_stack([one, (part**2).sum(1)]) if squares else one
                        sums[at] = sums[at] + one if at in sums else one
                for at, total in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at]), *(pa.array(np.ascontiguousarray(x)) for x in total.T)], ["at", *columns])

            return of

        try:
            some = F.lit(True) if len(needed) == len(self.place) else F.col("i").isin(needed) | F.col("j").isin(needed)
            made = [table().where(some).mapInArrow(products(tiles), "at long, " + ", ".join(f"{c} double" for c in columns)) for table, tiles in self.parts]
            found = reduce(DataFrame.unionByName, made).groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # a row for each name
        finally:
            sent.destroy()
        out = np.zeros((len(values), len(columns)))
        out[found["at"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in columns])
        return out


def row_clusters(r: DataFrame, k: int, seed: int, steps: int = 20, tol: float = 1e-4, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """symbol, cluster: k-means (k-means++, then Lloyd) on each name's whole row of correlations with all names.

    A row's distance to a centre needs their product alone, a sum over blocks
    of the matrix; the driver holds k numbers for each name.
    """
    path, rng = shared_path(r.sparkSession, "correlations"), np.random.default_rng(seed)
    try:
        matrix = CorrelationMatrix(r, path, kept_bytes)
        names = len(matrix.symbols)
        rows, dots, near, pick = [], [], None, int(rng.integers(names))
        for c in range(k):
            own = np.zeros((names, 1))
            own[pick] = 1
            rows.append(matrix.times(own))
            product = matrix.times(rows[c], squares=c == 0)
            norms = product[:, 1] if c == 0 else norms
            dots.append(product[:, :1])
            away = np.maximum(norms - 2 * product[:, 0] + norms[pick], 0)
            away[pick] = 0
            near = away if near is None else np.minimum(near, away)
            pick = int(rng.choice(names, p=near / near.sum())) if near.sum() > 0 else int(rng.integers(names))
        centres, dots = np.hstack(rows), np.hstack(dots)
        nearest = lambda: np.argmin((centres**2).sum(0) - 2 * dots, axis=1)
        for _ in range(steps):
            member = np.eye(k)[nearest()]
            size = member.sum(0)
            new = np.where(size > 0, matrix.times(member) / np.maximum(size, 1), centres)
            moved, centres = np.sqrt(((new - centres) ** 2).sum(0)).max(), new
            dots = matrix.times(centres)
            if moved <= tol:
                break
        return r.sparkSession.createDataFrame(pa.table({"symbol": pa.array(matrix.symbols), "cluster": pa.array(nearest().astype(np.int32))}))
    finally:
        removed(r.sparkSession, path)


def sector_clusters(panel: DataFrame, k: int = 20, seed: int = 7, days: int = 550, least: int = 120) -> DataFrame:
    """year, symbol, cluster for each year and name of the panel: k-means on each name's whole row of correlations.

    Names with fewer than `least` returns in a year's window have cluster -1, as
    have all names if fewer than `k` have enough. A few years are at work at once.
    """
    symbols, spark = panel.select("symbol").distinct(), panel.sparkSession

    def of_year(year: int) -> DataFrame:
        r = window_returns(panel, year, days)
        names = r.groupBy("symbol").count().where(F.col("count") >= least).select("symbol")
        all_names = symbols.select(F.lit(year).alias("year"), "symbol")
        if names.where("symbol is not null").count() < max(k, 1):
            return all_names.withColumn("cluster", F.lit(-1))
        found = row_clusters(r.join(names, "symbol", "left_semi"), k, seed)
        return all_names.join(found, "symbol", "left").select("year", "symbol", F.coalesce("cluster", F.lit(-1)).alias("cluster"))

    years = [row[0] for row in panel.select(F.year("date")).distinct().sort(F.year("date")).collect()]
    with ThreadPoolExecutor(4) as pool, shuffles_removed(spark):
        of_years = list(pool.map(inheritable_thread_target(spark)(of_year), years))
    return reduce(DataFrame.unionByName, of_years) if of_years else symbols.select(F.lit(0).alias("year"), "symbol", F.lit(-1).alias("cluster")).limit(0)


def sector_aggregates(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    """F16: by date and cluster: mean change, names, breadth, momentum of the five earlier rows; relative change of a name."""
    j = panel.join(clusters, "symbol")
    g = j.groupBy("date", "cluster").agg(F.avg("chg_ratio").alias("sec_mean"), F.count("*").alias("sec_n"), F.avg((F.col("chg_ratio") > 0).cast("double")).alias("sec_breadth"))
    w = W.partitionBy("cluster").orderBy("date").rowsBetween(-5, -1)
    g = g.withColumn("sec_mom5", F.when(F.count("sec_mean").over(w) >= 3, F.sum("sec_mean").over(w)))
    return j.join(g, ["date", "cluster"]).withColumn("sec_rel", F.col("chg_ratio") - F.col("sec_mean"))


# The labels of the ladder, first rung first, and the bounds of the rungs.
SCENARIOS = ("상한가 다음날", "상따", "상승형 음봉", "신고가", "신고가 근접", "120 돌파", "과열", "거래량 폭증", "미분류")
NEW_HIGH, NEAR_HIGH, CHASE_PLACE, CHASE_CHANGE, BEARISH_PLACE, OVER_MA20, OVER_VOLUME, SURGE = 0.99, 0.93, 0.90, 12.0, 0.40, 0.35, 2.3, 1.6
#: What the one-hot column of each label is called.
SCENARIO_COLUMNS = ("after_ceiling", "chase", "rising_bearish", "new_high", "near_high", "ma120_breakout", "overheated", "volume_surge", "unclassified")


def scenario_frame(panel: DataFrame) -> DataFrame:
    """what the ladder looks at: volume and price against their means, place in the day's range, MA120 cross, ceiling the row before."""
    w = by_symbol()
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    roll = lambda c, n, f, least: trailing(F.col(c), n, f, least, lag=0)
    p = panel.withColumn("_pc", F.lag("close").over(w)).withColumn("_ma120", roll("close", 120, F.avg, 60))
    p = with_extremes(p, {"_high": ("high", F.greatest)}, 252, 60).withColumn("_at_limit", M.is_ceiling(M.change_ratio(F.col("close"), F.col("_pc")), F.col("close"), F.col("high")))
    return (
        p.withColumn("vol_ratio_5_20", ratio(roll("volume", 5, F.avg, 3), roll("volume", 20, F.avg, 10)))
        .withColumn("dist_ma20", ratio(F.col("close"), roll("close", 20, F.avg, 10)) - 1)
        .withColumn("high_252d_ratio", ratio(F.col("close"), F.col("_high")))
        .withColumn("close_pos", ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")))
        .withColumn("change_rate", F.col("chg_ratio") * 100)
        .withColumn("ma120_breakout", F.coalesce((F.col("_pc") <= F.lag("_ma120").over(w)) & (F.col("close") > F.col("_ma120")), F.lit(False)))
        .withColumn("prev_ceiling", F.coalesce(F.lag("_at_limit").over(w), F.lit(False)))
        .drop("_pc", "_ma120", "_at_limit", "_high")
    )


def scenario_ladder(panel: DataFrame) -> DataFrame:
    """the label of the first rung that holds; a rung with an unknown number doesn't."""
    vol, place, chg, high = F.col("vol_ratio_5_20"), F.col("close_pos"), F.col("change_rate"), F.col("high_252d_ratio")
    rungs = (
        F.col("prev_ceiling"),
        (place >= CHASE_PLACE) & (chg >= CHASE_CHANGE),
        (place <= BEARISH_PLACE) & (chg > 0),
        high >= NEW_HIGH,
        high >= NEAR_HIGH,
        F.col("ma120_breakout"),
        (F.col("dist_ma20") >= OVER_MA20) & (vol >= OVER_VOLUME),
        vol >= SURGE,
    )
    label = F.lit(SCENARIOS[-1])
    for rung, name in reversed(list(zip(rungs, SCENARIOS, strict=False))):
        label = F.when(rung, name).otherwise(label)
    made = ("vol_ratio_5_20", "dist_ma20", "high_252d_ratio", "close_pos", "change_rate", "ma120_breakout", "prev_ceiling")
    return scenario_frame(panel).withColumn("scenario", label).drop(*made)


def scenario_agreement(rows: DataFrame, ours: str, theirs: str) -> DataFrame:
    """by label: support, recall and precision; and in all."""
    hit = (F.col(ours) == F.col(theirs)).cast("int")
    by_true = rows.groupBy(F.col(theirs).alias("label")).agg(F.count("*").alias("support"), F.avg(hit.cast("double")).alias("recall"))
    by_ours = rows.groupBy(F.col(ours).alias("label")).agg(F.avg(hit.cast("double")).alias("precision"))
    whole = rows.agg(F.lit("all").alias("label"), F.count("*").alias("support"), F.avg(hit.cast("double")).alias("recall"), F.avg(hit.cast("double")).alias("precision"))
    return by_true.join(by_ours, "label", "full").withColumn("support", F.coalesce("support", F.lit(0))).unionByName(whole)


def action_panel(rows: DataFrame) -> DataFrame:
    """exact duplicates once; a key with two versions fails the job; one-hots and how many labels a name has."""
    hot = [F.max((F.col("scenario") == s).cast("int")).alias(f"is_{c}") for s, c in zip(SCENARIOS, SCENARIO_COLUMNS, strict=True)]
    g = rows.dropDuplicates().groupBy("date", "symbol").agg(*hot, F.count("*").alias("n_scenarios"), F.count_distinct(F.coalesce("scenario", F.lit(""))).alias("_labels"))
    again = F.raise_error(F.concat_ws(" ", F.lit("two versions of"), F.col("date").cast("string"), F.col("symbol")))
    return g.withColumn("n_scenarios", F.when(F.col("_labels") < F.col("n_scenarios"), again).otherwise(F.col("n_scenarios"))).drop("_labels")


def live_features(past: DataFrame, today: DataFrame, day: str) -> DataFrame:
    """today's rows with the same features as the panel's: stitch, cross section, history."""
    from tapewright.operators.calendar import live_stitch

    joined = live_stitch(past, today, day)
    return cross_section(history(joined).where(F.col("date") == F.lit(day).cast("date")))


def feature_parity(a: DataFrame, b: DataFrame, names: Sequence[str], good: float = 0.95) -> DataFrame:
    """by feature: mean daily rank correlation, median absolute difference, verdict.

    Rows meet once and are then sent once by date, which serves every rank; of
    differences only the distinct ones of a feature go on to the median.
    """
    side = lambda df, to: df.select("date", "symbol", *(F.col(n).cast("double").alias(f"{to}{i}") for i, n in enumerate(names)))
    both = side(a, "x").join(side(b, "y"), ["date", "symbol"]).drop("symbol").repartition("date")
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i, n in enumerate(names)]
    j = both.select("date", F.explode(F.array(*pairs)).alias("p")).select("date", "p.*").where("x is not null and y is not null")
    w = W.partitionBy("date", "feature")
    # Twice the average rank: the counts up to the value and before it. Scale and place change no correlation.
    average = lambda c: F.count("*").over(w.orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow)) + F.rank().over(w.orderBy(c))
    ranked = j.withColumn("rx", average("x").cast("double")).withColumn("ry", average("y").cast("double"))
    moves = lambda c: F.min(c) < F.max(c)
    daily = ranked.groupBy("date", "feature").agg(F.when(moves("rx") & moves("ry") & (F.count("*") >= 3), F.covar_pop("rx", "ry") / (F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("rho"))
    rho = daily.groupBy("feature").agg(F.avg("rho").alias("spearman"))
    counted = j.groupBy("feature", F.abs(F.col("x") - F.col("y")).alias("diff")).agg(F.count("*").alias("k"))
    diff = counted.groupBy("feature").agg(F.percentile("diff", F.lit(0.5), F.col("k")).alias("median_diff"), F.sum("k").alias("n"))
    out = diff.join(rho, "feature", "left")
    return out.withColumn("verdict", F.when(F.col("spearman") >= good, "MATCH").when(F.col("spearman") >= 0.8, "APPROXIMATE").otherwise("MISMATCH"))


def noise_perturbation(rows: DataFrame, moves: DataFrame, seed: int = 3, draw: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """closes divided by (1 + a hashed draw of the moves), inside the day's range; values follow; F1 and F5 are computed anew.

    moves: slot, move: the observed auction moves numbered from 0.
    """
    n = moves.agg(F.count("*").alias("_n"))
    drawn = rows.crossJoin(F.broadcast(n)).withColumn("slot", F.pmod(draw(F.col("date"), F.col("symbol"), F.lit(seed)), F.col("_n"))).join(moves, "slot")
    moved = F.least(F.greatest(F.col("close") / (1 + F.col("move")), F.col("low")), F.col("high"))
    scaled = drawn.withColumn("_c", moved).withColumn("tv_clean", F.col("tv_clean") * F.col("_c") / F.col("close")).withColumn("close_raw", F.col("close_raw") * F.col("_c") / F.col("close")).withColumn("close", F.col("_c"))
    scaled = scaled.withColumn("tick_cost_bp", M.tick_cost_bp(F.col("close_raw"), F.col("market"), F.col("date")))
    return cost_features(cross_section(scaled.drop("slot", "move", "_n", "_c")))


FEATURE_CONTRACT = tuple((n, "ratio", "decision") for n in ("f_body", "f_upper", "f_range")) + tuple((n, "rank", "decision") for n in ("f_rank_tv", "f_rank_chg")) + tuple((n, "log", "previous session") for n in ("f_ret5", "f_ret20", "f_ret60"))


def feature_contract(spark, spearman: DataFrame) -> DataFrame:
    """name, unit and timing of features with their class by measured rank correlation."""
    table = spark.createDataFrame(list(FEATURE_CONTRACT), "feature string, unit string, timing string")
    return table.join(spearman.select("feature", "spearman", "verdict"), "feature", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNMEASURED")))


def require_no_labels(names: Sequence[str], labels: Sequence[str]) -> None:
    """Raises if a feature is a label."""
    if found := sorted(set(names) & set(labels)):
        raise ContractError(f"labels among the features: {', '.join(found)}")


def leakage_report(rows: DataFrame, names: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """For each feature of a frame how many rows have it and whether it is a label; what require_no_labels would stop."""
    known = rows.agg(*(F.count(n).alias(n) for n in names))
    return known.unpivot([], list(names), "feature", "n_known").withColumn("is_label", F.col("feature").isin(*labels))
