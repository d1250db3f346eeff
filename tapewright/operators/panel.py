"""The daily panel: integrity, derived columns, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions import market as M
from tapewright.functions.checks import require, stop_where
from tapewright.functions.windows import by_symbol, forward_fill, product_after

REQUIRED = ("date", "symbol", "market", "open", "high", "low", "close", "prev_close", "volume", "trade_value_100m", "market_cap_100m")


def prepare_price_panel(panel: DataFrame, padded: bool = False) -> DataFrame:
    """chg_ratio, tv_clean, mc_clean, is_ceiling, tick_cost_bp beside the panel's columns.

    padded: the symbols have six characters already, as in a stored panel, whose
    buckets by symbol then serve the windows without a shuffle.
    """
    p = require(panel, REQUIRED)
    p = (p if padded else p.withColumn("symbol", F.lpad("symbol", 6, "0"))).withColumn("market", F.coalesce("market", F.lit("UNKNOWN")))
    raw = F.coalesce("close_raw", "close") if "close_raw" in panel.columns else F.col("close")
    change = M.change_ratio(F.col("close"), F.col("prev_close"))
    return (
        p.withColumn("chg_ratio", change)
        .withColumn("tv_clean", F.coalesce("trade_value_100m", F.col("close") * F.col("volume") / 1e8))
        .withColumn("mc_clean", forward_fill(F.col("market_cap_100m")))
        .withColumn("is_ceiling", M.is_ceiling(F.col("chg_ratio"), F.col("close"), F.col("high")))
        .withColumn("tick_cost_bp", M.tick_cost_bp(raw, F.col("market"), F.col("date")))
    )


def panel_provenance(panel: DataFrame) -> DataFrame:
    """One row of counters about a prepared panel."""
    count = lambda c: F.count_if(c)
    return panel.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.count_distinct("date").alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        count(F.col("prev_close").isNull()).alias("n_no_prev"),
        count(F.col("chg_ratio").isNull()).alias("n_no_change"),
        count((F.col("prev_close") > 0) & F.col("chg_ratio").isNull()).alias("n_beyond_limit"),
        count(F.col("trade_value_100m").isNull()).alias("n_value_rebuilt"),
        count(F.col("market_cap_100m").isNull()).alias("n_cap_missing"),
        count(F.col("market_cap_100m").isNull() & F.col("mc_clean").isNotNull()).alias("n_cap_filled"),
        count(F.col("is_ceiling")).alias("n_ceiling"),
        count(F.col("market") == "UNKNOWN").alias("n_market_unknown"),
        count(F.col("tick_cost_bp").isNull()).alias("n_no_tick_cost"),
    )


def heal_previous_close(panel: DataFrame) -> DataFrame:
    """P5: a missing previous close is the symbol's close before; `healed` tells, chg_ratio is derived anew."""
    prior = F.lag("close").over(by_symbol())
    healed = panel.withColumn("healed", F.col("prev_close").isNull() & prior.isNotNull()).withColumn("prev_close", F.coalesce("prev_close", prior))
    return healed.withColumn("chg_ratio", M.change_ratio(F.col("close"), F.col("prev_close")))


def assert_units(panel: DataFrame, stored: str, rtol: float = 1e-6) -> DataFrame:
    """The stored change must be the derived one; a row whose isn't fails the job."""
    derived = M.change_ratio(F.col("close"), F.col("prev_close"))
    return stop_where(panel, F.abs(F.col(stored) - derived) > rtol * F.abs(derived), "stored change differs", ("date", "symbol", stored), stored)


def mixed_unit_report(panel: DataFrame, stored: str) -> DataFrame:
    """Rows whose stored change is in per cent."""
    return panel.where(M.is_mixed_unit(F.col(stored), F.col("chg_ratio")))


def breadth_by_date(panel: DataFrame) -> DataFrame:
    up, down = F.count_if(F.col("chg_ratio") > 0), F.count_if(F.col("chg_ratio") < 0)
    return panel.groupBy("date").agg(up.alias("advances"), down.alias("declines"), F.when(up + down > 0, (up - down) / (up + down)).alias("breadth"))


def latest_breadth(panel: DataFrame, before: str) -> DataFrame:
    """Breadth of the last date strictly before `before`."""
    past = panel.where(F.col("date") < F.lit(before).cast("date"))
    last = past.agg(F.max("date").alias("date"))
    return breadth_by_date(past.join(F.broadcast(last), "date"))


def base_price_events(panel: DataFrame, sessions: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Factor, event, gap_jump, implied_share_ratio; `base_price` is the exchange's reference for the day.

    A base that differs from the close of the previous session by more than
    the tolerance is an event; if the symbol's row before is older than the
    previous session, it is a gap jump and not an event.
    """
    w = by_symbol()
    rows = panel.withColumn("_prior_close", F.lag("close_raw").over(w)).withColumn("_prior_date", F.lag("date").over(w))
    rows = rows.join(sessions.select("date", "prev_date"), "date", "left")
    off = F.coalesce(F.abs(F.col("base_price") - F.col("_prior_close")) > tolerance, F.lit(False))
    event = off & F.coalesce(F.col("_prior_date") == F.col("prev_date"), F.lit(False))
    ratio = F.col("base_price") / F.col("_prior_close")
    return (
        rows.withColumn("event", event)
        .withColumn("gap_jump", off & ~event)
        .withColumn("factor", F.when(event, ratio).otherwise(F.lit(1.0)))
        .withColumn("implied_share_ratio", F.when(event, F.col("_prior_close") / F.col("base_price")))
        .drop("_prior_close", "_prior_date", "prev_date")
    )


def back_adjust(events: DataFrame) -> DataFrame:
    """Prices times the product of the factors of later rows; the raw close stays."""
    scale = product_after(F.col("factor"))
    out = events.withColumn("scale", scale)
    for name in ("open", "high", "low", "close", "prev_close"):
        out = out.withColumn(name, F.col(name) * F.col("scale"))
    return out


def merge_and_adjust(stored: DataFrame, new: DataFrame, sessions: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """P10: appends newer rows, finds events among them alone, rescales the history; `changed` marks rows to write."""
    both = stored.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    found = base_price_events(both, sessions, tolerance)
    found = found.withColumn("factor", F.when(F.col("is_new"), F.col("factor")).otherwise(F.lit(1.0))).withColumn("event", F.col("event") & F.col("is_new"))
    adjusted = back_adjust(found)
    return adjusted.withColumn("changed", F.col("is_new") | (F.abs(F.col("scale") - 1) > 1e-12))


def adjudicate(events: DataFrame, shares: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Confirmed (the other vendor has the factor), corroborated (the share count moved alike), rejected, unverified."""
    near = lambda a, b: F.abs(a / b - 1) <= tolerance
    j = events.join(shares, ["date", "symbol"], "left")
    verdict = (
        F.when(F.coalesce(near(F.col("vendor_factor"), F.col("factor")), F.lit(False)), "confirmed")
        .when(F.coalesce(near(F.col("share_ratio"), F.col("implied_share_ratio")), F.lit(False)), "corroborated")
        .when(F.col("vendor_factor").isNotNull(), "rejected")
        .otherwise("unverified")
    )
    return j.withColumn("verdict", verdict)


def event_sample(events: DataFrame, n_controls: int) -> DataFrame:
    """Rows that disagree with the old panel, and agreeing controls spread evenly over (date, symbol)."""
    bad = events.where("event and disagrees").withColumn("role", F.lit("disagrees"))
    calm = events.where("not disagrees")
    total = calm.agg(F.count("*").alias("_n"))
    # Positions by date first: a count for each date, so that no window holds all rows.
    per_date = calm.groupBy("date").agg(F.count("*").alias("_k"))
    offset = per_date.withColumn("_before", F.coalesce(F.sum("_k").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = calm.withColumn("_r", F.row_number().over(W.partitionBy("date").orderBy("symbol")) - 1).join(F.broadcast(offset), "date").crossJoin(F.broadcast(total))
    pos = F.col("_before") + F.col("_r")
    bucket = lambda p: F.floor(p * n_controls / F.col("_n"))
    even = (F.col("_n") <= n_controls) | (pos == 0) | (bucket(pos) != bucket(pos - 1))
    controls = placed.where(even).drop("_k", "_before", "_r", "_n").withColumn("role", F.lit("control"))
    return bad.unionByName(controls)


def carry_flows(rebuilt: DataFrame, old: DataFrame, flows: tuple[str, ...]) -> DataFrame:
    """Flows of the old panel by key; the rows stay as many."""
    right = old.select("date", "symbol", *flows).dropDuplicates(["date", "symbol"])
    return rebuilt.drop(*flows).join(right, ["date", "symbol"], "left")


def validate_rebuild(rebuilt: DataFrame, old: DataFrame, shrink: float = 0.97) -> DataFrame:
    """By date: rows, duplicates, bad raw prices, rows against the old panel, share of equal closes."""
    ours = rebuilt.groupBy("date", "symbol").agg(F.count("*").alias("k"), F.max("close_raw").alias("close_raw"))
    theirs = old.groupBy("date", "symbol").agg(F.max("close_raw").alias("old_raw"))
    both = ours.join(theirs, ["date", "symbol"], "full")
    out = both.groupBy("date").agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k") - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("close_raw") <= 0).alias("n_bad_raw"),
        F.count("old_raw").alias("n_old"),
        F.avg((F.col("close_raw") == F.col("old_raw")).cast("int")).alias("match_rate"),
    )
    return out.withColumn("shrunk", F.col("n_rows") < F.col("n_old") * shrink)


def day_block_failures(panel: DataFrame, rtol: float = 0.005) -> DataFrame:
    """Counts of rows that fail each check, by date."""
    rate = F.col("close") / F.col("prev_close") - 1
    return panel.groupBy("date").agg(
        F.count_if(F.col("close") <= 0).alias("bad_close"),
        F.count_if(F.col("prev_close") <= 0).alias("bad_base"),
        F.count_if(F.abs(rate - F.col("stored_rate")) > rtol).alias("rate_mismatch"),
        F.count_if((F.col("low") > F.col("high")) | (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("bad_ohlc"),
    )


def day_continuity(panel: DataFrame, sessions: DataFrame, least_ratio: float = 0.97, most_stale: float = 0.05) -> DataFrame:
    """Rows against the session before, and the share of names whose whole bar repeats."""
    bar = F.struct("open", "high", "low", "close", "volume")
    today = panel.select("date", "symbol", bar.alias("bar"))
    before = today.join(F.broadcast(sessions.select(F.col("prev_date").alias("date"), F.col("date").alias("next"))), "date").select(F.col("next").alias("date"), "symbol", F.col("bar").alias("old"))
    j = today.join(before, ["date", "symbol"], "full")
    out = j.groupBy("date").agg(F.count("bar").alias("n_rows"), F.count("old").alias("n_before"), F.count_if(F.col("bar") == F.col("old")).alias("n_stale"), F.count_if(F.col("bar").isNotNull() & F.col("old").isNotNull()).alias("n_common"))
    stale = F.when(F.col("n_common") > 0, F.col("n_stale") / F.col("n_common"))
    ok = ((F.col("n_before") == 0) | (F.col("n_rows") >= least_ratio * F.col("n_before"))) & F.coalesce(stale <= most_stale, F.lit(True))
    return out.withColumn("stale_share", stale).withColumn("ok", ok)


def flow_coverage(panel: DataFrame) -> DataFrame:
    """By date the share of traded rows that have all flows."""
    whole = F.col("inst_netbuy").isNotNull() & F.col("foreign_netbuy").isNotNull() & F.col("program_netbuy").isNotNull()
    return panel.where("volume > 0").groupBy("date").agg(F.count("*").alias("n_traded"), F.avg(whole.cast("int")).alias("coverage"))


def flow_repair_plan(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Symbols with a missing flow between two dates."""
    gap = F.col("inst_netbuy").isNull() | F.col("foreign_netbuy").isNull() | F.col("program_netbuy").isNull()
    return panel.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & gap).groupBy("symbol").agg(F.count("*").alias("n_missing"), F.min("date").alias("first_missing"))


def fill_flows(panel: DataFrame, fetched: DataFrame, flows: tuple[str, ...]) -> DataFrame:
    """Only cells that are NULL are filled."""
    right = fetched.select("date", "symbol", *(F.col(f).alias(f"_{f}") for f in flows)).dropDuplicates(["date", "symbol"])
    j = panel.join(right, ["date", "symbol"], "left")
    for f in flows:
        j = j.withColumn(f, F.coalesce(f, f"_{f}")).drop(f"_{f}")
    return j


def volatility_proxy(levels: DataFrame, rows: int = 20, over: str | None = None, level: str = "level", name: str = "vol_proxy") -> DataFrame:
    """Population deviation of the last `rows` log ratios, times sqrt(252) * 100; NULL with fewer."""
    w = (W.partitionBy(over) if over else W.partitionBy(F.lit(1))).orderBy("date")  # a table of dates, not of rows
    ratio = levels.withColumn("_lr", F.log(F.col(level) / F.lag(level).over(w)))
    frame = w.rowsBetween(-(rows - 1), 0)
    value = F.when(F.count("_lr").over(frame) == rows, F.stddev_pop("_lr").over(frame) * (252**0.5) * 100)
    return ratio.withColumn(name, value).drop("_lr")


def live_proxy(levels: DataFrame, today: DataFrame, rows: int = 20, over: str | None = None) -> DataFrame:
    """P20: the proxy of today's level appended to the levels strictly before it."""
    keys = [over] if over else []
    now = today.select(*keys, "date", "level").withColumn("_live", F.lit(True))
    cut = F.broadcast(now.select(*keys, F.col("date").alias("_today")))
    past = (levels.join(cut, keys) if keys else levels.crossJoin(cut)).where("date < _today").select(*keys, "date", "level").withColumn("_live", F.lit(False))
    return volatility_proxy(past.unionByName(now), rows, over).where("_live").drop("_live")


def index_by_date(panel: DataFrame) -> DataFrame:
    """Mean change of each board, chained levels and their volatility proxies, one row a date."""
    board = lambda name: F.avg(F.when(F.col("market") == name, F.col("chg_ratio")))
    daily = panel.groupBy("date").agg(board("KOSPI").alias("kospi_pct"), board("KOSDAQ").alias("kosdaq_pct"))
    w = W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = daily
    for name in ("kospi", "kosdaq"):
        out = out.withColumn(f"{name}_level", 100 * F.exp(F.sum(F.log1p(F.coalesce(F.col(f"{name}_pct"), F.lit(0.0)))).over(w)))
        out = volatility_proxy(out, level=f"{name}_level", name=f"v_{name}")
    return out


def attach_index(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Index columns of the date; a date of the panel without a row there fails the job."""
    j = panel.join(index.withColumn("_has", F.lit(True)), "date", "left")
    return stop_where(j, F.col("_has").isNull(), "no index row", ("date",), next(c for c in index.columns if c != "date")).drop("_has")


def price_basis(panel: DataFrame) -> DataFrame:
    """Whether the close is adjusted, by comparing rounded prices."""
    adjusted = F.round("close") != F.round("close_raw")
    return panel.select("date", "symbol", F.coalesce(adjusted, F.lit(False)).alias("adjusted"), (F.col("close").isNotNull() & F.col("close_raw").isNotNull()).alias("known"))


def price_anomaly() -> Column:
    """For quoted rows only."""
    odd = (F.col("close") <= 0) | (F.col("low") > F.col("high")) | ~F.col("close").between(F.col("low"), F.col("high")) | (F.col("volume") < 0)
    return F.coalesce(F.col("close").isNotNull() & odd, F.lit(False))


def coverage_verdict(snapshot: DataFrame, most: float = 0.05) -> DataFrame:
    """By date the degraded share and COMPLETE or PARTIAL."""
    bad = F.col("close").isNull() | price_anomaly()
    out = snapshot.groupBy("date").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_degraded"))
    return out.withColumn("share", F.col("n_degraded") / F.col("n_rows")).withColumn("verdict", F.when(F.col("share") <= most, "COMPLETE").otherwise("PARTIAL"))


def confirm_close(decisions: DataFrame, finals: DataFrame, rtol: float = 0.005) -> DataFrame:
    """P25: the confirmed close where it is acceptable, with the reason where it is not; decision prices stay.

    finals: symbol, code, hms, close, close_again, volume, rate.
    """
    j = decisions.join(finals.select("symbol", F.col("code"), "hms", F.col("close").alias("final"), F.col("close_again"), F.col("volume").alias("final_volume"), "rate"), "symbol", "left")
    from tapewright.functions.checks import first_reason

    reason = first_reason(
        [
            ("no_final", F.col("final").isNull()),
            ("code", F.col("code") != F.col("symbol")),
            ("clock", F.col("hms") < 153000),
            ("two_prices", F.col("final") != F.col("close_again")),
            ("price", F.col("final") <= 0),
            ("volume", F.col("final_volume") < F.col("volume")),
            ("rate", F.abs(F.col("final") / F.col("prev_close") - 1 - F.col("rate")) > rtol),
        ]
    )
    return j.withColumn("reason", reason).withColumn("close_final", F.when(F.col("reason").isNull(), F.col("final")))


def pending_order(df: DataFrame) -> DataFrame:
    """Picks, then admitted names, then the rest; their position within."""
    turn = F.when(F.col("selected"), 0).when(F.col("admitted"), 1).otherwise(2)
    return df.withColumn("turn", turn).withColumn("place", F.row_number().over(W.partitionBy("date").orderBy("turn", "symbol")).cast("long"))


def eligible_listings(today: DataFrame, listings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Names listed on the previous session; `reason` for the others."""
    past = sessions.select("date", F.col("prev_date").alias("_prev"))
    j = today.join(F.broadcast(past), "date", "left").join(listings.select(F.col("date").alias("_prev"), "symbol", F.lit(True).alias("listed")).distinct(), ["_prev", "symbol"], "left")
    reason = F.when(F.col("_prev").isNull(), "no_previous_session").when(F.col("listed").isNull(), "not_listed_before")
    return j.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull()).drop("_prev", "listed")


def fingerprint(panel: DataFrame) -> DataFrame:
    """What tells one state of the panel from another."""
    return panel.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("symbol").alias("n_symbols"), F.sum(F.floor("close").cast("long")).alias("close_sum"))


def compare_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.select(*(F.col(c).alias(f"old_{c}") for c in old.columns)), new
    j = n.crossJoin(o)  # one row each
    verdict = F.when(F.col("n_rows") < F.col("old_n_rows"), "SHRUNK").when(F.col("last_date") < F.col("old_last_date"), "STALE").when(F.col("first_date") != F.col("old_first_date"), "HEAD_MOVED").otherwise("OK")
    return j.withColumn("verdict", verdict)
