"""No look-ahead, closed failures, reasons, hand-computed numbers."""

import collections
import datetime as dt
import glob
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import market as M
from tapewright.functions.checks import ContractError, require, split_by_reason, unique
from tapewright.functions.windows import clip, pct_rank_avg, product_after, trailing, with_extremes
from tapewright.operators import calendar as C
from tapewright.operators import features as X
from tapewright.operators import ledgers as G
from tapewright.operators import normalize as N
from tapewright.operators import panel as P
from tapewright.operators import universe as U
from tapewright.plans import fixtures, store_queries  # noqa: F401  registers its queries
from tapewright.plans.oracle import QUERIES

DIR = "/root/testdata/sf0.001"
D = [dt.date(2024, 1, d) for d in range(1, 29)]


def panel(spark):
    return P.prepare_price_panel(fixtures.price_history(spark, DIR))


def test_ticks_by_date_and_board(spark):
    rows = [(1999.0, "KOSPI", "2024-01-02", 1.0), (2000.0, "KOSDAQ", "2024-01-02", 5.0), (600000.0, "KOSDAQ", "2022-01-03", 100.0), (600000.0, "KOSPI", "2022-01-03", 1000.0), (1500.0, "KOSDAQ", "2022-01-03", 5.0)]
    df = spark.createDataFrame(rows, "price double, market string, date string, want double").withColumn("date", F.to_date("date"))
    assert df.where(M.tick_size(F.col("price"), F.col("market"), F.col("date")) != F.col("want")).count() == 0


def test_tax_steps_and_change_limit(spark):
    df = spark.createDataFrame([("2019-06-02", 30.0), ("2019-06-03", 25.0), ("2025-12-31", 15.0)], "d string, want double").withColumn("d", F.to_date("d"))
    assert df.where(M.tax_bp(F.col("d")) != F.col("want")).count() == 0
    one = spark.createDataFrame([(130.0, 100.0), (132.0, 100.0), (1.0, 0.0), (None, 1.0)], "c double, p double").select(M.change_ratio(F.col("c"), F.col("p")).alias("r")).collect()
    assert [r.r is None for r in one] == [False, True, True, True]


def test_average_rank_and_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None)], "date string, x double")
    got = sorted(str(r.p) for r in df.select(pct_rank_avg(F.col("x")).alias("p")).collect())
    assert got == sorted(["0.5", "0.5", "1.0", "None"])
    assert df.select(clip(F.col("x"), 0, 2).alias("c")).where("c is null").count() == 1


def test_trailing_needs_its_values_and_excludes_the_row(spark):
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(D[:6])], "symbol string, date date, x double")
    got = [r.m for r in df.select("date", trailing(F.col("x"), 3, F.sum, 2).alias("m")).orderBy("date").collect()]
    assert got == [None, None, 1.0, 3.0, 6.0, 9.0]
    assert [r.p for r in df.select("date", product_after(F.col("x") + 1).alias("p")).orderBy("date").collect()][-2:] == [6.0, 1.0]


@pytest.mark.parametrize("build,names", [(X.history, ("f_ret20", "f_on_mean20", "f_inst_cum5", "f_upcount20")), (X.core_history, ("h_amihud20",)), (X.trailing_features, ("t_vol20", "t_flow_z"))])
def test_no_look_ahead(spark, build, names):
    p = panel(spark)
    cut = F.lit("2023-06-01").cast("date")
    later = F.col("date") > cut
    moved = p.withColumn("chg_ratio", F.when(later, F.lit(0.3)).otherwise(F.col("chg_ratio"))).withColumn("inst_netbuy", F.when(later, F.lit(1e6)).otherwise(F.col("inst_netbuy"))).withColumn("close", F.when(later, F.lit(1.0)).otherwise(F.col("close")))
    keep = lambda df: {tuple(r) for r in build(df).where(F.col("date") <= cut).select("date", "symbol", *(F.round(n, 8) for n in names)).collect()}
    assert keep(p) == keep(moved)


def test_restricted_equals_whole(spark):
    p = panel(spark)
    keys = p.where("day(date)=15").select("date", "symbol")
    cols = ["date", "symbol", F.round("f_ret20", 8).alias("a"), F.round("f_on_mean60", 8).alias("b")]
    a = {tuple(r) for r in X.restricted(p, keys).select(*cols).collect()}
    b = {tuple(r) for r in X.history(p).where("day(date)=15").select(*cols).collect()}
    assert a == b and a


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([("s", D[2]), ("s", D[0]), ("t", D[1])], "symbol string, date date")
    right = spark.createDataFrame([("s", D[0], 1.0), ("s", D[2], 3.0)], "symbol string, date date, v double")
    strict = {(r.symbol, r.date): r.v_asof for r in C.asof_join(left, right, ["v"]).collect()}
    assert strict == {("s", D[2]): 1.0, ("s", D[0]): None, ("t", D[1]): None}
    inclusive = {(r.symbol, r.date): r.v_asof for r in C.asof_join(left, right, ["v"], inclusive=True).collect()}
    assert inclusive[("s", D[2])] == 3.0 and inclusive[("s", D[0])] == 1.0


def test_contracts_fail_closed(spark):
    df = spark.createDataFrame([("s", D[0]), ("s", D[0])], "symbol string, date date")
    with pytest.raises(ContractError):
        unique(df, ["symbol", "date"])
    with pytest.raises(ContractError):
        require(df, ["close"])
    with pytest.raises(ContractError):
        P.prepare_price_panel(df)
    with pytest.raises(ContractError):
        X.require_no_labels(["f_body", "net"], ["net"])
    with pytest.raises(ValueError):
        N.vendor_bars(df, "nobody")


def test_every_excluded_row_has_the_first_reason(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    kept, gone = split_by_reason(df, [("two", F.col("x") == 2), ("more", F.col("x") >= 2)])
    assert kept.count() == 1 and {(r.x, r.reason) for r in gone.collect()} == {(2, "two"), (3, "more")}


def test_exit_statuses(spark):
    days = D[:4]
    rows = [("a", d, 10.0, 10.0, 5.0) for d in days] + [("b", days[0], 10.0, 10.0, 5.0), ("b", days[2], 12.0, 10.0, 5.0), ("c", days[0], 10.0, 10.0, 5.0)]
    p = spark.createDataFrame(rows, "symbol string, date date, open double, close double, volume double")
    cal = C.sessions(p)
    got = {(r.symbol, r.date): (r.status, r.holding_days, r.exit_price, r.exit_date) for r in U.forward_exit(p, p, cal).collect()}
    assert got[("a", days[0])] == ("EXIT_TRADABLE", 1, 10.0, days[1])
    assert got[("a", days[3])] == ("EXIT_TRADABLE", 1, None, None)
    assert got[("b", days[0])] == ("EXIT_SUSPENDED", 2, 12.0, days[2])
    assert got[("c", days[0])] == ("UNRESOLVED_EXIT", 20, 5.0, None)


def test_orders_and_round_trips(spark):
    ev = spark.createDataFrame(
        [(1, 0, "INTENT", None, 10, None), (1, 1, "SEND", None, 10, None), (2, 0, "SEND", None, 10, None), (2, 1, "RESULT", "rejected", 10, None), (3, 0, "SEND", None, 10, None), (3, 1, "RESULT", "accepted", 10, None), (3, 2, "BROKER_STATE", "final", 10, 4), (4, 0, "SKIP", None, 10, None)],
        "intent_id int, seq int, kind string, outcome string, qty int, filled int",
    )
    assert {r.intent_id: r.status for r in G.order_state(ev).collect()} == {1: "UNKNOWN", 2: "REJECTED", 3: "PARTIAL", 4: "SKIPPED"}


def test_fill_decision_makes_no_pairs(spark):
    rng = random.Random(4)
    at = lambda: dt.datetime(2024, 1, rng.randint(1, 9), rng.randint(9, 11), rng.randint(0, 3))
    prints = [(rng.choice("ab"), at(), i, rng.choice([None, *range(1, 40)])) for i in range(300)]
    orders = [(i, rng.choice("abc"), rng.choice(["buy", "sell", None]), at(), rng.choice(["market", "limit"]), rng.choice([None, 0, 41, *range(1, 40)])) for i in range(300)]
    o = spark.createDataFrame(orders, "order_id long, symbol string, side string, placed_at timestamp_ntz, rule string, limit_price int")
    p = spark.createDataFrame(prints, "symbol string, printed_at timestamp_ntz, print_id long, price int")

    def takes(order, price):
        _, _, side, _, rule, limit = order
        return rule == "market" or (price is not None and limit is not None and ((side == "buy" and price <= limit) or (side == "sell" and price >= limit)))

    want = {}
    for x in orders:
        # A market order needs no side.
        first = min(((t, i, price) for s, t, i, price in prints if s == x[1] and t > x[3] and takes(x, price)), key=lambda q: q[:2], default=None)
        want[x[0]] = (first and first[0], first and first[2], "FILLED" if first else "UNFILLED")
    for rows in (5, 4000):
        found = G.fill_decision(o, p, rows=rows)
        assert {r.order_id: (r.printed_at, r.price, r.status) for r in found.collect()} == want and found.count() == len(orders)
    assert not any("Join" in line and "symbol" in line and "range" not in line and "from" not in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_fill_decision_of_a_burst_of_nothing_and_of_nan(spark):
    at = dt.datetime(2024, 1, 2, 9)
    prints = [("a", at, i, float(100 - i % 50)) for i in range(500)] + [("a", at, 900, float("nan")), (None, at, 901, 1.0), ("a", None, 902, 1.0)]
    before, later = at - dt.timedelta(minutes=1), at + dt.timedelta(minutes=1)
    orders = [(1, "a", "buy", before, "limit", 51.0), (2, "a", "buy", before, "limit", 50.0), (3, "a", "sell", at, "limit", 1.0), (4, "a", "buy", before, "limit", float("nan")), (5, None, "buy", before, "market", None), (6, "a", "buy", later, "market", None), (7, "a", "sell", before, "limit", 99.5), (8, "a", "buy", None, "market", None)]
    o = spark.createDataFrame(orders, "order_id long, symbol string, side string, placed_at timestamp_ntz, rule string, limit_price double")
    p = spark.createDataFrame(prints, "symbol string, printed_at timestamp_ntz, print_id long, price double")
    for rows in (7, 4000):
        got = {r.order_id: r.price for r in G.fill_decision(o, p, rows=rows).collect()}
        assert got == {1: 51.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 100.0, 8: None}
    assert G.fill_decision(o.limit(0), p).count() == 0
    assert {r.status for r in G.fill_decision(o, p.limit(0)).collect()} == {"UNFILLED"}


def test_whole_tables_are_ordered_audited_and_run(spark):
    events = fixtures.base(spark, DIR, "events")
    assert QUERIES["g8_fill_decision"](spark, DIR).count() == events.count()
    days = {(r[0], r[1]) for r in events.select("event_type", F.to_date("ts")).distinct().collect()}
    assert sum(r.length for r in QUERIES["g17_streaks"](spark, DIR).collect()) == len(days)
    runs, due = collections.defaultdict(list), {(k, dt.datetime(d.year, d.month, d.day, 9)) for k, d in days}
    for r in events.select("event_type", "ts", "event_id").collect():
        runs[r.event_type].append((r.ts.replace(tzinfo=None), r.event_id))
    for r in QUERIES["g18_job_lateness"](spark, DIR).collect():
        until = min((d for k, d in due if k == r.job and d > r.due_at), default=r.due_at + dt.timedelta(days=1))
        assert (r.state == "MISSING") == (not any(r.due_at <= t < until for t, _ in runs[r.job]))


def test_sector_clusters_use_whole_rows_of_every_year(spark):
    rng, names = random.Random(2), [f"{i:02}" for i in range(30)]  # more than 4 * k
    rows = []
    for d in [dt.date(y, 6, 1) + dt.timedelta(days=i) for y in (2021, 2022) for i in range(40)]:
        group = [rng.gauss(0, 0.02), rng.gauss(0, 0.02)]
        rows += [(d, s, 100 * math.exp(group[int(s) % 2] + rng.gauss(0, 0.004)), 100.0) for s in names]
    rows += [(dt.date(2022, 6, 1) + dt.timedelta(days=i), "new", 101.0 + i, 100.0) for i in range(3)] + [(dt.date(2023, 1, 2), "00", 100.0, 100.0)]
    p = spark.createDataFrame(rows, "date date, symbol string, close double, prev_close double")
    got = {(r.year, r.symbol): r.cluster for r in X.sector_clusters(p, k=2, least=15).collect()}
    assert set(got) == {(y, s) for y in (2021, 2022, 2023) for s in [*names, "new"]}
    assert all(got[2021, s] == -1 for s in names) and {got[y, "new"] for y in (2021, 2022, 2023)} == {-1}
    for y in (2022, 2023):
        assert {got[y, s] for s in names} == {0, 1} and all(got[y, s] == got[y, f"{int(s) % 2:02}"] for s in names)
    first = {s: [math.log(c / q) for d, x, c, q in rows if x == s and d.year == 2021] for s in names}
    want = np.corrcoef([first[s] for s in names])
    vectors = {r.symbol: r.features.toArray() for r in X.correlation_rows(X.window_returns(p, 2022), spark.createDataFrame([(s,) for s in names], "symbol string")).collect()}
    assert np.allclose([vectors[s] for s in names], want)
    apart = spark.createDataFrame([(dt.date(2021, 1, 1 + d), s, float(1 + d * (2 if s == "b" else 3) % 5)) for d in range(5) for s in ("b", "d")] + [(dt.date(2021, 2, 1), s, 1.0) for s in ("a", "c", "e")], "date date, symbol string, r double")
    alone = {r.symbol: r.features.toArray().round(6).tolist() for r in X.correlation_rows(apart, apart.select("symbol").distinct()).collect()}
    c = round(float(np.corrcoef([1 + d * 2 % 5 for d in range(5)], [1 + d * 3 % 5 for d in range(5)])[0, 1]), 6)
    assert alone == {"a": [1, 0, 0, 0, 0], "b": [0, 1, 0, c, 0], "c": [0, 0, 1, 0, 0], "d": [0, c, 0, 1, 0], "e": [0, 0, 0, 0, 1]}


def returns(spark, names, seed=3):
    rng = random.Random(seed)
    days = [dt.date(2021, 1, 1) + dt.timedelta(d) for d in range(40)]
    common = {d: [rng.gauss(0, 1) for _ in range(3)] for d in days}
    r = {s: {d: common[d][i % 3] + rng.gauss(0, 0.3) for d in rng.sample(days, rng.randint(1, 30))} for i, s in enumerate(names)}
    r[names[0]] = dict.fromkeys(days, 0.5)
    return r, spark.createDataFrame([(d, s, v) for s, of in r.items() for d, v in of.items()], "date date, symbol string, r double")


def correlation(a, b):
    met = sorted(a.keys() & b.keys())
    x, y = (np.array([t[d] for d in met]) for t in (a, b))
    return len(met), float(np.corrcoef(x, y)[0, 1]) if len(met) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0 else None


def test_correlations_of_many_blocks_by_loops(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_NAMES", 6)
    r, df = returns(spark, [f"{i:02}" for i in range(40)])
    out = X.return_correlations(df.union(spark.createDataFrame([(dt.date(2021, 1, 1), None, 1.0)], df.schema)), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # no copies of returns for each block
    got = {(x.a, x.b): (x.n, x.corr) for x in out.collect()}
    want = {(a, b): correlation(r[a], r[b]) for a in r for b in r if a < b}
    assert got == {k: (n, c if c is None else pytest.approx(c)) for k, (n, c) in want.items() if n >= 3} and (None in {c for _, c in got.values()})


def test_clusters_without_a_stored_matrix(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_NAMES", 6)
    names = [f"{i:02}" for i in range(40)]
    r, df = returns(spark, names)
    want = np.array([[1.0 if a == b else correlation(r[a], r[b])[1] or 0.0 for b in names] for a in names])
    values, top = np.random.default_rng(1).normal(size=(40, 2)), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for kept, tiles in ((0, False), (6000, True), (1 << 20, True)):
        at = f"{top}/matrix-{kept}"
        matrix = X.CorrelationMatrix(df, at, kept)
        got = matrix.times(values, squares=True)
        assert matrix.symbols == names and np.allclose(got[:, :2], want @ values) and np.allclose(got[:, 2], (want**2).sum(1))
        size = sum(os.path.getsize(f) for f in glob.glob(f"{at}/tiles/*.parquet"))
        assert os.path.isdir(f"{at}/tiles") == tiles and len(matrix.parts) == (2 if kept == 6000 else 1) and (size > 0) == tiles
    before = set(os.listdir(top))
    found = [{x.symbol: x.cluster for x in X.row_clusters(df, 3, 7, kept_bytes=kept).collect()} for kept in (0, 1 << 20)]
    assert found[0] == found[1] and set(os.listdir(top)) == before
    panel = df.withColumn("close", F.exp("r")).withColumn("prev_close", F.lit(1.0)).union(spark.createDataFrame([(dt.date(2022, 1, 3), "00", 0.0, 1.0, 1.0)], "date date, symbol string, r double, close double, prev_close double"))
    assert X.sector_clusters(panel, k=3, least=2).count() == 80 and set(os.listdir(top)) == before


def test_feature_parity_by_loops_in_few_shuffles(spark):
    rng = random.Random(8)
    draw = lambda: rng.choice([None, 0.0, 1.0, 2.0, rng.random()])
    keys = [(d, f"{s:02}") for d in D[:6] for s in range(12 if d != D[3] else 2)]
    x, y = ({k: (draw(), draw() if k[0] != D[4] else 1.0) for k in rng.sample(keys, len(keys) - 3)} for _ in range(2))
    frame = lambda t: spark.createDataFrame([(*k, *v) for k, v in t.items()], "date date, symbol string, f double, g double")
    out = X.feature_parity(frame(x), frame(y), ["f", "g"])
    got = {r.feature: (r.n, r.median_diff, r.spearman, r.verdict) for r in out.collect()}
    mean_rank = lambda v, all_v: sum(w < v for w in all_v) + (sum(w == v for w in all_v) + 1) / 2
    for i, name in enumerate(("f", "g")):
        met = [(k[0], x[k][i], y[k][i]) for k in x if k in y and x[k][i] is not None and y[k][i] is not None]
        rhos = []
        for d in {m[0] for m in met}:
            a, b = ([m[c] for m in met if m[0] == d] for c in (1, 2))
            if len(a) >= 3 and min(a) < max(a) and min(b) < max(b):
                rhos.append(np.corrcoef([mean_rank(v, a) for v in a], [mean_rank(v, b) for v in b])[0, 1])
        assert got[name] == (len(met), pytest.approx(np.median([abs(a - b) for _, a, b in met])), pytest.approx(np.mean(rhos)), "MISMATCH")
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"[+-] Exchange hashpartitioning", plan)) <= 6  # two of the join, by date, by difference, two by feature


def test_derived_tables_leave_no_shuffle_files(spark):
    top = spark.conf.get("spark.local.dir")
    files = lambda: set(glob.glob(f"{top}/**/shuffle_*", recursive=True))
    before, kept = files(), dict(fixtures._stored)
    fixtures._stored.clear()
    try:
        assert fixtures.price_history(spark, DIR).count() and fixtures.bars_1m(spark, DIR).count()
        left = [f for f in files() - before if f.endswith(".data") and os.path.getsize(f) > 10_000]
    finally:
        fixtures._stored.update(kept)
    assert not left


def test_broker_matches_deal_each_side_once(spark):
    terms = "symbol string, side string, qty long, limit_price double"
    i = spark.createDataFrame([(1, "a", "buy", 5, 1.0), (2, "a", "buy", 6, 1.0), (3, None, "buy", 5, 1.0)], f"intent_id long, {terms}")
    o = spark.createDataFrame([(k, "a", "buy", 5, 1.0) for k in (10, 11, 12, 13)] + [(14, "a", "sell", 5, 1.0), (15, None, "buy", 5, 1.0)], f"broker_id long, {terms}")
    gone = lambda *ids: spark.createDataFrame([(k,) for k in ids], "broker_id long")
    assert sorted(tuple(r) for r in G.broker_matches(i, o, gone(11, 11, None), gone(12)).collect()) == [(1, 10), (1, 13)]
    plan = QUERIES["g3_broker_matches"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side; the others are small enough to be sent


def test_extremes_equal_sliding_windows(spark):
    rng = random.Random(4)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), s, None if rng.random() < 0.3 else rng.random()) for s in ("a", "b") for d in range(70)]
    p = spark.createDataFrame(rows, "date date, symbol string, x double")
    for length in (1, 2, 7, 32, 60):
        got = with_extremes(p, {"top": ("x", F.greatest), "low": ("x", F.least)}, length, min(length, 5))
        want = p.withColumn("top", trailing(F.col("x"), length, F.max, min(length, 5), lag=0)).withColumn("low", trailing(F.col("x"), length, F.min, min(length, 5), lag=0))
        key = lambda df: sorted(str((r.symbol, r.date, r.x, r.top, r.low)) for r in df.select("symbol", "date", "x", "top", "low").collect())
        assert key(got) == key(want)


def test_masking(spark):
    got = spark.createDataFrame([("token=abc123, x Bearer abcdefghij",), (None,)], "t string").select(N.mask_secrets(F.col("t")).alias("t")).collect()
    assert got[0].t == "token=***, x Bearer ***" and got[1].t is None
