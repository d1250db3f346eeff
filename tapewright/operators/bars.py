"""One-minute bars, ticks and the 15:20 panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions import market as M
from tapewright.functions.checks import first_reason
from tapewright.functions.windows import clean

DAY = ("snapshot_date", "symbol")
OPEN_MIN, DECISION_MIN, CLOSE_MIN = 540, 920, 930
# Whether a vendor stamps a bar with its start or its end, and whether its traded value must be rebuilt.
STAMP_SHIFT = {"kis": 1, "ls": 1, "dbsec": 1, "kiwoom": 1, "toss": 0}
REBUILT_VALUE = ("toss",)
# First minute, cutoff (exclusive) and tolerances (short, surplus) by session.
SESSION_CUTOFF = {"regular": 930, "evening": 1200, "premarket": None}
SHORT_TOLERANCE = {"regular": 0.01, "evening": 0.0, "premarket": 0.0}
SURPLUS_TOLERANCE = {"regular": None, "evening": 0.01, "premarket": 0.01}


def minute_of(hms: Column) -> Column:
    return (F.floor(hms / 10000) * 60 + F.floor(hms / 100) % 100).cast("int")


def end_minute(hms: Column, vendor: Column) -> Column:
    """B2: the minute at which a bar ends; NULL for a vendor whose stamp isn't known."""
    shift = F.create_map(*(F.lit(x) for kv in STAMP_SHIFT.items() for x in kv))
    return minute_of(hms) + F.element_at(shift, vendor)


def typical_value(bars: DataFrame) -> DataFrame:
    """Volume * (h + l + c) / 3 for vendors without a value."""
    rebuilt = F.col("volume") * (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("value_krw", F.when(F.col("vendor").isin(*REBUILT_VALUE), rebuilt).otherwise(F.col("value_krw")))


def decision_bars(bars: DataFrame, excluded: tuple[str, ...] = (), floor: int = OPEN_MIN, cutoff: int = DECISION_MIN) -> DataFrame:
    """B1: a row for each symbol and day: OHLC of traded bars, volume and value of all bars in the window, or a reason."""
    b = typical_value(bars).withColumn("end_min", end_minute(F.col("ts_hms"), F.col("vendor")))
    inside = (F.col("end_min") - 1 >= floor) & (F.col("end_min") <= cutoff)
    traded = inside & F.col("has_trade")
    at = F.struct("end_min", "ts_hms")
    g = b.groupBy(*DAY).agg(
        F.min("vendor").alias("vendor"),
        F.count_distinct("vendor").alias("n_vendors"),
        F.max(F.col("vendor").isin(*excluded) if excluded else F.lit(False)).alias("has_excluded"),
        F.max(F.col("end_min").isNull()).alias("unknown_stamp"),
        F.count_if(traded).alias("n_traded"),
        F.min_by("open", F.when(traded, at)).alias("open"),
        F.max(F.when(traded, F.col("high"))).alias("high"),
        F.min(F.when(traded, F.col("low"))).alias("low"),
        F.max_by("close", F.when(traded, at)).alias("close"),
        F.sum(F.when(inside, F.col("volume"))).alias("volume"),
        F.sum(F.when(inside, F.col("value_krw"))).alias("value_krw"),
    )
    reason = first_reason(
        [
            ("vendor_excluded", F.col("has_excluded")),
            ("unknown_stamp", F.col("unknown_stamp")),
            ("mixed_vendor", F.col("n_vendors") > 1),
            ("no_traded_bar", F.col("n_traded") == 0),
            ("invalid_price", (F.least("open", "high", "low", "close") <= 0) | (F.col("low") > F.col("high"))),
        ]
    )
    return g.withColumn("reason", reason).drop("has_excluded", "unknown_stamp", "n_vendors")


def vendor_gaps(bars: DataFrame, share: float = 0.2, least_symbols: int = 30) -> DataFrame:
    """Minutes of a day in which a vendor's traded names fall below a share of the day's median."""
    b = bars.withColumn("minute", minute_of(F.col("ts_hms")))
    names = b.groupBy("snapshot_date", "vendor").agg(F.count_distinct(F.when(F.col("has_trade"), F.col("symbol"))).alias("n_symbols"))
    grid = names.where(F.col("n_symbols") >= least_symbols).withColumn("minute", F.explode(F.sequence(F.lit(OPEN_MIN), F.lit(CLOSE_MIN - 1))))
    counts = b.where("has_trade").groupBy("snapshot_date", "vendor", "minute").agg(F.count_distinct("symbol").alias("n"))
    full = grid.join(counts, ["snapshot_date", "vendor", "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    median = F.percentile("n", F.lit(0.5)).over(W.partitionBy("snapshot_date", "vendor"))
    return full.withColumn("median", median).where(F.col("n") < share * F.col("median")).drop("n_symbols")


def decision_day_rows(decision: DataFrame, opening: DataFrame, history: DataFrame, official_open: DataFrame) -> DataFrame:
    """Decision bars beside the previous session's raw close, scaled cap and flows, or a reason.

    opening: the range of the first minutes. history: prev_close, factor, cap,
    flows as of T-1. official_open: the day's raw open. Reasons in order: not in
    history, previous close, head truncated, previous cap.
    """
    j = decision.join(opening, list(DAY), "left").join(history, list(DAY), "left").join(official_open, list(DAY), "left")
    prev = F.col("prev_close") * F.col("factor")
    tick = M.tick_size(F.col("official_open"), F.coalesce("market", F.lit("UNKNOWN")), F.col("snapshot_date"))
    head_ok = F.col("official_open").between(F.col("first_low") - tick, F.col("first_high") + tick)
    reason = first_reason(
        [
            ("not_in_history", F.col("in_history").isNull()),
            ("prev_close", prev.isNull() | (prev <= 0)),
            ("head_truncated", ~F.coalesce(head_ok, F.lit(False))),
            ("prev_cap", F.col("prev_cap").isNull()),
        ]
    )
    return j.withColumn("prev_close_raw", prev).withColumn("cap", F.col("prev_cap") * F.col("close") / prev).withColumn("day_reason", F.coalesce("reason", reason))


def opening_range(bars: DataFrame, minutes: int = 5) -> DataFrame:
    early = bars.where((minute_of(F.col("ts_hms")) < OPEN_MIN + minutes) & F.col("has_trade"))
    return early.groupBy(*DAY).agg(F.min("low").alias("first_low"), F.max("high").alias("first_high"))


def panel_build(live: DataFrame, from_bars: DataFrame, superset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, coverage by date): a live row where there is one, else bars; superset names in neither are counted by cause."""
    both = live.withColumn("source", F.lit("live")).unionByName(from_bars.join(live.select(*DAY), list(DAY), "left_anti").withColumn("source", F.lit("bars")), allowMissingColumns=True)
    j = superset.join(both.select(*DAY, "source", "reason"), list(DAY), "left")
    cause = F.when(F.col("source").isNull(), F.when(F.col("adjusted"), "price_basis_adjusted").otherwise("not_fetched")).otherwise(F.col("reason"))
    cover = j.withColumn("cause", cause).groupBy("snapshot_date").agg(
        F.count("*").alias("n_superset"), F.count_if(F.col("cause").isNull()).alias("n_rows"), F.count_if(F.col("source") == "live").alias("n_live"), F.count_if(F.col("cause") == "not_fetched").alias("n_not_fetched"), F.count_if(F.col("cause") == "price_basis_adjusted").alias("n_adjusted")
    )
    return both.where("reason is null"), cover.withColumn("coverage", F.col("n_rows") / F.col("n_superset"))


def path_features(bars: DataFrame, least_bars: int = 30) -> DataFrame:
    """13 features of a symbol's path to the decision; days with fewer bars have no row."""
    b = bars.withColumn("end_min", end_minute(F.col("ts_hms"), F.col("vendor"))).where((F.col("end_min") > OPEN_MIN) & (F.col("end_min") <= DECISION_MIN))
    w = W.partitionBy(*DAY).orderBy("end_min")
    b = b.withColumn("_lr", F.log(F.col("close") / F.lag("close").over(w))).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    at = lambda m: F.max_by("close", F.when(F.col("end_min") <= m, F.col("end_min")))
    late = F.col("end_min") > 860
    volume = F.sum("volume")
    share = lambda m: F.sum(F.when(F.col("end_min") > m, F.col("volume")).otherwise(0)) / F.nullif(volume, F.lit(0))
    g = b.groupBy(*DAY).agg(
        F.count("*").alias("n_bars"),
        F.min_by("open", "end_min").alias("_open"),
        at(DECISION_MIN).alias("_last"),
        *(at(m).alias(f"_c{m}") for m in (570, 720, 860, 890)),
        (F.sum(F.col("_tp") * F.col("volume")) / F.nullif(volume, F.lit(0))).alias("_vwap"),
        share(860).alias("x_late60"),
        share(890).alias("x_late30"),
        F.min_by("end_min", F.struct(-F.col("high"), F.col("end_min"))).alias("_hi"),
        F.min_by("end_min", F.struct(F.col("low"), F.col("end_min"))).alias("_lo"),
        (F.stddev_pop("_lr") * F.sqrt(F.count("_lr"))).alias("x_rv1m"),
        F.when(F.count(F.when(late, F.col("_lr"))) > 5, F.stddev_pop(F.when(late, F.col("_lr")))).alias("x_rv_late"),
        F.avg((F.col("volume") <= 0).cast("double")).alias("x_zero_vol"),
    )
    g = g.where(F.col("n_bars") >= least_bars)
    over = lambda a, c: F.col(a) / F.nullif(F.col(c), F.lit(0.0)) - 1
    return g.select(
        *DAY,
        "n_bars",
        over("_last", "_c890").alias("x_r30"),
        over("_last", "_c860").alias("x_r60"),
        over("_last", "_c720").alias("x_r_pm"),
        over("_c720", "_open").alias("x_r_am"),
        over("_c570", "_open").alias("x_r_open30"),
        over("_last", "_vwap").alias("x_vwap_dev"),
        "x_late60",
        "x_late30",
        ((F.col("_hi") - OPEN_MIN) / 380).alias("x_t_high"),
        ((F.col("_lo") - OPEN_MIN) / 380).alias("x_t_low"),
        "x_rv1m",
        "x_rv_late",
        "x_zero_vol",
    )


def attach_with_floor(rows: DataFrame, parts: list[DataFrame], keys: list[str], columns: list[str], floor: float = 0.8) -> DataFrame:
    """Left joins of feature tables; `ok` tells whether each date's share of finite values reaches the floor."""
    for part in parts:
        rows = rows.join(part, keys, "left")
    filled = [F.avg(F.col(c).isNotNull().cast("double")).over(W.partitionBy(keys[0])) for c in columns]
    return rows.withColumn("least_share", F.least(*filled) if len(filled) > 1 else filled[0]).withColumn("ok", F.col("least_share") >= floor)


def auction_impact(bars: DataFrame, least_bars: int = 10) -> DataFrame:
    """The auction's last close against the last continuous one in bp, and its volume and value shares."""
    m = minute_of(F.col("ts_hms"))
    b = bars.withColumn("m", m)
    auction = F.col("m") >= DECISION_MIN
    g = b.groupBy(*DAY).agg(
        F.count_if(~auction).alias("n_continuous"),
        F.max_by("close", F.when(~auction, F.col("m"))).alias("continuous_close"),
        F.max_by("close", F.when(auction, F.col("m"))).alias("auction_close"),
        F.sum(F.when(auction, F.col("volume")).otherwise(0)).alias("auction_volume"),
        F.sum(F.when(auction, F.col("value_krw")).otherwise(0)).alias("auction_value"),
        F.sum("volume").alias("day_volume"),
        F.sum("value_krw").alias("day_value"),
    )
    impact = F.when(F.col("n_continuous") >= least_bars, (F.col("auction_close") / F.col("continuous_close") - 1) * 1e4)
    return g.withColumn("impact_bp", impact).withColumn("volume_share", F.col("auction_volume") / F.nullif("day_volume", F.lit(0))).withColumn("value_share", F.col("auction_value") / F.nullif("day_value", F.lit(0)))


def collapse_duplicates(bars: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(identical rows once, keys that still conflict)."""
    once = bars.dropDuplicates()
    clash = once.groupBy(*keys).agg(F.count("*").alias("n_versions")).where("n_versions > 1")
    return once.join(clash, keys, "left_anti"), clash


def coverage_outliers(bars: DataFrame, share: float = 0.8, edge: int = 30) -> DataFrame:
    """Symbols of a day with far fewer bars than the fullest, or that begin late or end early."""
    m = minute_of(F.col("ts_hms"))
    g = bars.groupBy(*DAY).agg(F.count("*").alias("n_bars"), F.min(m).alias("first_min"), F.max(m).alias("last_min"))
    most = F.max("n_bars").over(W.partitionBy("snapshot_date"))
    few, late, early = F.col("n_bars") < share * most, F.col("first_min") > OPEN_MIN + edge, F.col("last_min") < CLOSE_MIN - edge
    return g.withColumn("few", few).withColumn("late_start", late).withColumn("early_end", early).where("few or late_start or early_end")


def certified_admission(bars: DataFrame, certificates: DataFrame) -> DataFrame:
    """Bars with a reason where the symbol's day isn't certified or a price isn't positive."""
    j = bars.join(certificates.select(*DAY, F.lit(True).alias("certified")), list(DAY), "left")
    return j.withColumn("reason", first_reason([("uncertified", F.col("certified").isNull()), ("price", F.least("open", "high", "low", "close") <= 0)])).drop("certified")


def comparable_volumes(bars: DataFrame, ticks: DataFrame, session: str = "regular") -> DataFrame:
    """Bar volume before the session's cutoff and tick volume, by symbol and day."""
    cutoff = SESSION_CUTOFF[session]
    kept = bars if cutoff is None else bars.where(minute_of(F.col("ts_hms")) < cutoff)
    return kept.groupBy(*DAY).agg(F.sum("volume").alias("bar_volume")).join(ticks.groupBy(*DAY).agg(F.sum("volume").alias("tick_volume")), list(DAY), "full")


def tick_bar_relation(volumes: DataFrame, session: str = "regular") -> DataFrame:
    """B15"""
    b, t = F.coalesce("bar_volume", F.lit(0)), F.coalesce("tick_volume", F.lit(0))
    most = SURPLUS_TOLERANCE[session]
    relation = F.when(t < b * (1 - SHORT_TOLERANCE[session]), "TICK_SHORT")
    if most is not None:
        relation = relation.when(t > b * (1 + most), "TICK_SURPLUS")
    return volumes.withColumn("relation", relation.otherwise("CONSISTENT"))


def shortfall_class(relations: DataFrame, certified: DataFrame, small: float = 0.05, systemic: float = 0.05) -> DataFrame:
    """What a tick shortfall means, and whether the day's share of excess makes it systemic."""
    j = relations.where("relation = 'TICK_SHORT'").join(certified.select(*DAY, F.lit(True).alias("certified")), list(DAY), "left")
    gap = 1 - F.coalesce("tick_volume", F.lit(0)) / F.col("bar_volume")
    kind = F.when(F.col("certified").isNull(), "LOST").when(gap <= small, "SOURCE_DIFF").otherwise("SOURCE_DIFF_EXCESS")
    names = relations.groupBy("snapshot_date").agg(F.count("*").alias("_names"))
    out = j.withColumn("gap", gap).withColumn("kind", kind).join(names, "snapshot_date")
    excess = F.sum((F.col("kind") == "SOURCE_DIFF_EXCESS").cast("int")).over(W.partitionBy("snapshot_date"))
    return out.withColumn("systemic", excess / F.col("_names") > systemic).drop("_names", "certified")


def dense_grid_audit(bars: DataFrame, names: DataFrame, first: int = OPEN_MIN, last: int = CLOSE_MIN - 1) -> DataFrame:
    """By day: names without a bar, stamps that are missing, stamps that shouldn't be. names: snapshot_date, symbol."""
    m = bars.select(*DAY, minute_of(F.col("ts_hms")).alias("minute")).distinct()
    inside = F.col("minute").between(first, last)
    per = m.groupBy(*DAY).agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))
    j = names.join(per, list(DAY), "left")
    return j.groupBy("snapshot_date").agg(
        F.count_if(F.col("n_inside").isNull()).alias("missing_symbols"),
        F.sum((last - first + 1) - F.coalesce("n_inside", F.lit(0))).alias("missing_bars"),
        F.sum(F.coalesce("n_outside", F.lit(0))).alias("unexpected_bars"),
    )


def sparse_window_audit(bars: DataFrame, first: int, last: int) -> DataFrame:
    """B18"""
    m = minute_of(F.col("ts_hms"))
    return bars.where(~m.between(first, last)).groupBy("snapshot_date").agg(F.count("*").alias("n_bars"), F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("ts_hms").alias("n_stamps"))


def value_violation(exempt: tuple[str, ...] = ("toss",)) -> Column:
    """A value outside [low * volume, high * volume]."""
    return F.coalesce(~F.col("vendor").isin(*exempt) & ~F.col("value_krw").between(F.col("low") * F.col("volume"), F.col("high") * F.col("volume")), F.lit(False))


def bad_price() -> Column:
    """B20"""
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = F.lit(False)
    for c in price:
        bad = bad | c.isNull() | (c <= 0)
    return bad


def repair_value(bars: DataFrame) -> DataFrame:
    """B22, N1's rule: a violating value becomes 0 for no volume, else close * volume."""
    fixed = F.when(F.col("volume") == 0, F.lit(0.0)).otherwise(F.col("close") * F.col("volume"))
    return bars.withColumn("repaired", value_violation(())).withColumn("value_krw", F.when(F.col("repaired"), fixed).otherwise(F.col("value_krw")))


def vendor_equivalence(start_stamped: DataFrame, end_stamped: DataFrame) -> DataFrame:
    """By symbol and day: bars on both sides, share of equal OHLC and volume, bars on one side only."""
    cols = ("open", "high", "low", "close", "volume")
    a = start_stamped.select(*DAY, minute_of(F.col("ts_hms")).alias("minute"), F.struct(*cols[:4]).alias("pa"), F.col("volume").alias("va"))
    b = end_stamped.select(*DAY, (minute_of(F.col("ts_hms")) - 1).alias("minute"), F.struct(*cols[:4]).alias("pb"), F.col("volume").alias("vb"))
    both = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    g = a.join(b, [*DAY, "minute"], "full").groupBy(*DAY).agg(F.count_if(both).alias("n_both"), F.count_if(F.col("pb").isNull()).alias("only_a"), F.count_if(F.col("pa").isNull()).alias("only_b"), F.count_if(both & (F.col("pa") == F.col("pb"))).alias("_p"), F.count_if(both & (F.col("va") == F.col("vb"))).alias("_v"))
    return g.withColumn("ohlc_equal", F.col("_p") / F.nullif("n_both", F.lit(0))).withColumn("volume_equal", F.col("_v") / F.nullif("n_both", F.lit(0))).drop("_p", "_v")


def basis_verdict(bars: DataFrame, eod: DataFrame, least: float = 0.9, tolerance: float = 0.01) -> DataFrame:
    """Bar volume against the day's official volume."""
    j = bars.groupBy(*DAY).agg(F.sum("volume").alias("bar_volume")).join(eod, list(DAY))
    ratio = F.col("bar_volume") / F.nullif("eod_volume", F.lit(0))
    return j.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio.isNull(), "no_volume").when(ratio < least, "short").when(ratio > 1 + tolerance, "surplus").otherwise("ok"))


def sampled_days(days: DataFrame, n: int, key: Column) -> DataFrame:
    """N symbol-days by the least hash; `key` is a hash of the day with a seed."""
    return days.withColumn("_h", key).orderBy("_h", *DAY).limit(n).drop("_h")


def calibration_rows(bars: DataFrame, consolidated: DataFrame, eod: DataFrame) -> DataFrame:
    """By symbol-day: the primary and the consolidated volume to the cutoff, the auction's print, both closes, ranges.

    bars, consolidated: start-stamped bars of the primary venue and of all venues; eod: the official volume, that of the primary venue.
    """
    early = F.col("m") < DECISION_MIN
    m = minute_of(F.col("ts_hms"))
    g = bars.withColumn("m", m).groupBy(*DAY).agg(
        F.sum(F.when(early, F.col("volume"))).cast("double").alias("v_krx_1520"),
        F.sum(F.when(~early, F.col("volume")).otherwise(0)).cast("double").alias("auction_volume"),
        F.max(F.when(early, F.col("high"))).alias("high_1520"),
        F.min(F.when(early, F.col("low"))).alias("low_1520"),
        F.max_by("close", F.when(early, F.col("m"))).alias("close_krx_1519"),
        F.max_by("close", "m").alias("close_eod"),
    )
    c = consolidated.withColumn("m", m).where(early).groupBy(*DAY).agg(F.sum("volume").cast("double").alias("v_cons_1520"), F.max_by("close", "m").alias("close_cons_1519"))
    return g.join(c, list(DAY)).join(eod, list(DAY))


def eligible_calibration(calibration: DataFrame, tolerance: float) -> DataFrame:
    """Rows whose official volume is the bars' and the auction's within the tolerance, with the true share; others take no part in anything."""
    known = [clean(F.col(c).cast("double")) for c in ("eod_volume", "v_krx_1520", "v_cons_1520", "auction_volume")]
    eod, krx, cons, auction = known
    fine = (eod > 0) & (krx > 0) & (cons > 0) & (auction >= 0) & (F.abs(eod - (krx + auction)) / eod <= tolerance)
    return calibration.where(F.coalesce(fine, F.lit(False))).withColumn("true_share", krx / cons)


def share_proxies(calibration: DataFrame, auction_mean: Column) -> DataFrame:
    """The official volume without the mean auction share, over the consolidated volume to the cutoff; NULL where either is missing or not positive."""
    eod, cons = clean(F.col("eod_volume").cast("double")), clean(F.col("v_cons_1520").cast("double"))
    fine = (eod > 0) & (cons > 0) & (auction_mean >= 0) & (auction_mean < 1)
    return calibration.withColumn("proxy", F.when(fine, eod * (1 - auction_mean) / cons))


def auction_fraction(eligible: DataFrame) -> DataFrame:
    """One row: the mean share of the auction in the official volume."""
    return eligible.agg(F.avg(F.col("auction_volume") / F.col("eod_volume")).alias("auction_mean"))


def _ewma(values: Column, alpha: float) -> Column:
    """The moving average that begins with the first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), lambda acc, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)


def raw_predictions(history: DataFrame, alphas: Sequence[float], structures: Sequence[tuple[int, int]]) -> DataFrame:
    """history with a row for each (alpha, min_prior_days, max_gap_days): n_prior and raw, the moving average of the proxies known in the max_gap_days days before the row's, NULL if they are fewer than min_prior_days.

    One window over a symbol's days for each gap; what is held for a row is at most that gap's days.
    """
    day = F.unix_date("snapshot_date")
    gaps = sorted({gap for _, gap in structures})
    known = lambda gap: F.collect_list("proxy").over(W.partitionBy("symbol").orderBy(day).rangeBetween(-gap, -1)) if gap else F.array().cast("array<double>")
    rows = history.withColumns({f"_k{gap}": known(gap) for gap in gaps})
    found = [
        F.struct(F.lit(float(a)).alias("ewma_alpha"), F.lit(least).alias("min_prior_days"), F.lit(gap).alias("max_gap_days"), F.size(f"_k{gap}").alias("n_prior"), F.when(F.size(f"_k{gap}") >= least, _ewma(F.col(f"_k{gap}"), float(a))).alias("raw"))
        for a in alphas
        for least, gap in structures
    ]
    return rows.withColumn("_c", F.explode(F.array(*found))).select(*history.columns, "_c.*")


def predicted_share(raw: Column, bias: Column) -> Column:
    """The raw average times the bias; NULL outside (0, 1]."""
    share = raw * bias
    return F.when((share > 0) & (share <= 1), share)


def ewma_prediction(proxies: DataFrame, alpha: float, least: int = 3, most_gap: int = 10, bias: float = 1.0) -> DataFrame:
    """The bias-corrected moving average of proxies dated 1 to most_gap days before; NULL with fewer than `least` of them or out of (0, 1].

    proxies: symbol, snapshot_date, proxy; a row without a proxy is a day to predict that adds nothing to later ones.
    """
    rows = raw_predictions(proxies, (alpha,), ((least, most_gap),))
    return rows.withColumn("prediction", predicted_share(F.col("raw"), F.lit(bias))).drop("ewma_alpha", "min_prior_days", "max_gap_days", "raw")


def estimator_rows(calibration: DataFrame, tolerance: float, holdout_fraction: float) -> DataFrame:
    """Eligible rows with their part: the earliest dates are the holdout, the later half of the others is for selection, the rest only history."""
    rows = eligible_calibration(calibration, tolerance)
    every = W.partitionBy(F.lit(1))  # a table of dates
    dates = rows.select("snapshot_date").distinct().withColumn("_i", F.row_number().over(every.orderBy("snapshot_date"))).withColumn("_n", F.count("*").over(every))
    held = F.ceil(F.col("_n") * holdout_fraction)
    first = held + F.greatest(F.lit(1), F.floor((F.col("_n") - held) / 2))
    part = F.when(F.col("_i") <= held, "holdout").when(F.col("_i") > first, "selection").otherwise("history")
    return rows.join(F.broadcast(dates.select("snapshot_date", part.alias("part"))), "snapshot_date")


def _errors(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    e = F.abs(F.col("share") - F.col("true_share")) / F.col("true_share")
    quantiles = [F.percentile(e, F.lit(q)).alias(f"rel_err_p{n}") for q, n in ((0.5, 50), (0.9, 90), (0.99, 99))]
    return scored.groupBy(*by).agg(F.count("*").alias("n_rows"), (F.count("share") / F.count("*")).alias("coverage"), *quantiles)


def estimator_frontier(rows: DataFrame, alphas: Sequence[float], structures: Sequence[tuple[int, int]]) -> DataFrame:
    """Each candidate's own bias (the median of true over raw), coverage and errors on the selection rows, in the order of choice.

    rows: estimator_rows. Order: coverage, then p90, then fewer prior days, then the longer gap, then the smaller alpha.
    """
    fit = rows.where("part <> 'holdout'")
    history = share_proxies(fit.crossJoin(F.broadcast(auction_fraction(fit))), F.col("auction_mean"))
    keys = ["ewma_alpha", "min_prior_days", "max_gap_days"]
    chosen = raw_predictions(history.select("symbol", "snapshot_date", "part", "true_share", "proxy"), alphas, sorted(set(structures))).where("part = 'selection'")
    bias = chosen.where("raw > 0").groupBy(*keys).agg(F.percentile(F.col("true_share") / F.col("raw"), F.lit(0.5)).alias("bias"))
    scored = chosen.join(F.broadcast(bias), keys, "left").withColumn("share", predicted_share(F.col("raw"), F.col("bias")))
    table = _errors(scored, keys).join(F.broadcast(bias), keys, "left")  # a row for each candidate
    order = [F.desc("coverage"), F.asc_nulls_last("rel_err_p90"), "min_prior_days", F.desc("max_gap_days"), "ewma_alpha"]
    return table.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))


def fit_estimator(calibration: DataFrame, alphas: Sequence[float], structures: Sequence[tuple[int, int]], tolerance: float, holdout_fraction: float, min_holdout_days: int, most_p90: float) -> DataFrame:
    """One row, the config chosen on the later dates and its diagnostics on the isolated earliest ones.

    The parameters, the bias and the mean auction share are of the fit dates;
    errors, coverage and the closes' difference are of the holdout. Raises
    ValueError for grids or fractions that make no sense, too few dates, rows
    or symbols, no candidate within most_p90, or a holdout that can't be scored.
    """
    grid = sorted({float(a) for a in alphas})
    if len(grid) < 3 or not all(0 < a <= 1 for a in grid):
        raise ValueError("at least three distinct alphas in (0, 1] are needed")
    if not structures or any(least < 1 or gap < 0 for least, gap in structures):
        raise ValueError("structures are pairs of min_prior_days from 1 and max_gap_days from 0")
    if tolerance <= 0 or not 0 < holdout_fraction <= 0.5 or min_holdout_days < 1 or most_p90 < 0:
        raise ValueError("tolerance, holdout_fraction, min_holdout_days or most_p90 out of range")
    rows = estimator_rows(calibration, tolerance, holdout_fraction)
    held, fit = rows.where("part = 'holdout'"), rows.where("part <> 'holdout'")
    days = rows.agg(
        F.count_distinct(F.when(F.col("part") == "holdout", F.col("snapshot_date"))).alias("held"), F.count_distinct(F.when(F.col("part") != "holdout", F.col("snapshot_date"))).alias("fit"),
        F.count_if(F.col("part") != "holdout").alias("rows"), F.count_distinct(F.when(F.col("part") != "holdout", F.col("symbol"))).alias("symbols"),
    ).first()
    if days.held < min_holdout_days:
        raise ValueError(f"{days.held} holdout dates, fewer than {min_holdout_days}")
    if days.fit < 2 or days.rows < 2 or days.symbols < 2:
        raise ValueError(f"{days.rows} fit rows of {days.symbols} symbols on {days.fit} dates")
    frontier = estimator_frontier(rows, grid, structures)
    best = frontier.where(F.col("rel_err_p90") <= most_p90).orderBy("place").first()
    if best is None:
        raise ValueError(f"no candidate within a p90 error of {most_p90}")

    mean = F.broadcast(auction_fraction(fit))
    history = share_proxies(held.crossJoin(mean), F.col("auction_mean"))
    scored = raw_predictions(history, (best.ewma_alpha,), ((best.min_prior_days, best.max_gap_days),)).withColumn("share", predicted_share(F.col("raw"), F.lit(best.bias)))
    errors = _errors(scored).select(F.col("n_rows").alias("n_holdout_rows"), F.col("coverage").alias("holdout_coverage"), *(F.col(f"rel_err_p{q}").alias(f"holdout_rel_err_p{q}") for q in (50, 90, 99)))
    transfer = scored.where("share is not null").agg(F.percentile(F.col("true_share") / F.col("raw"), F.lit(0.5)).alias("bias_holdout"))
    closes = [clean(F.col(c).cast("double")) for c in ("close_krx_1519", "close_cons_1519")]
    apart = F.when((closes[0] > 0) & (closes[1] > 0), F.abs(closes[1] - closes[0]) / closes[0] * 1e4)
    earlier = held.agg(F.avg(F.col("auction_volume") / F.col("eod_volume")).alias("auction_fraction_holdout"), F.percentile(apart, F.lit(0.9)).alias("close_bp_err_p90"), F.min("snapshot_date").alias("holdout_start"), F.max("snapshot_date").alias("holdout_end"))
    later = fit.agg(F.avg(F.col("auction_volume") / F.col("eod_volume")).alias("auction_fraction_mean"), F.min("snapshot_date").alias("fit_start"), F.max("snapshot_date").alias("calibrated_through"), F.count("*").alias("n_fit_rows"))
    names = rows.agg(F.count_distinct("symbol").alias("n_symbols"))
    out = errors.crossJoin(transfer).crossJoin(earlier).crossJoin(later).crossJoin(names)  # one row each
    chosen = {"ewma_alpha": best.ewma_alpha, "min_prior_days": best.min_prior_days, "max_gap_days": best.max_gap_days, "bias_correction": best.bias, "alpha_at_boundary": best.ewma_alpha in (grid[0], grid[-1])}
    out = out.select(*(F.lit(v).alias(c) for c, v in chosen.items()), "*")
    whole = F.col("bias_holdout").isNotNull() & F.col("close_bp_err_p90").isNotNull()
    return out.where(F.when(whole, True).otherwise(F.raise_error(F.lit("the holdout cannot be scored with the chosen parameters")).cast("boolean")))


def reconstruct(bars: DataFrame, shares: DataFrame, volume_error: float, close_error: float) -> DataFrame:
    """Consolidated volumes times the day's share, values rebuilt from typical prices, the basis and both error bounds beside them.

    A bar after the cutoff, a share outside (0, 1], a price that isn't positive or a negative volume stops the run.
    """
    j = bars.join(shares, list(DAY))
    fine = (minute_of(F.col("ts_hms")) <= DECISION_MIN) & (F.col("prediction") > 0) & (F.col("prediction") <= 1) & (F.least("high", "low", "close") > 0) & (F.col("volume") >= 0)
    whole = F.when(F.coalesce(fine & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull(), F.lit(False)), F.col("volume") * F.col("prediction")).otherwise(F.raise_error(F.lit("a bar or a share cannot be reconstructed")).cast("double"))
    v = F.col("volume_est")
    return j.withColumn("volume_est", whole).withColumn("value_est", v * (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("volume_low", v * (1 - volume_error)).withColumn("volume_high", v * (1 + volume_error)).withColumn("basis", F.lit("krx_reconstructed")).withColumn("recon_volume_rel_err_p90", F.lit(volume_error)).withColumn("recon_close_bp_err_p90", F.lit(close_error))


def auction_moves(bars: DataFrame) -> DataFrame:
    """Symbol-days with a continuous and an auction close: the move from one to the other and the auction's share of the value."""
    both = auction_impact(bars, 1).where("continuous_close > 0 and auction_close is not null")
    return both.select(*DAY, (F.col("auction_close") / F.col("continuous_close") - 1).alias("move"), "value_share")


def needed_tapes(needed: DataFrame, stored: DataFrame, relations: DataFrame) -> DataFrame:
    """Symbol-days whose tape is missing or short, in the order in which they are walked."""
    j = needed.join(stored.select(*DAY, F.lit(True).alias("has")), list(DAY), "left").join(relations.select(*DAY, "relation"), list(DAY), "left")
    why = F.when(F.col("has").isNull(), "missing").when(F.col("relation") == "TICK_SHORT", "short")
    return j.withColumn("why", why).where("why is not null").withColumn("walk", F.row_number().over(W.partitionBy("snapshot_date").orderBy(F.col("why"), "symbol")).cast("long")).select(*DAY, "why", "walk")
