"""Hand-computed cases: share estimator, order state in a stream, monthly base and patches, attribution, certification, verdicts, weights."""

import datetime as dt
import math
import random
import re
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from tapewright.operators import attribution as A
from tapewright.operators import bars as B
from tapewright.operators import certification as K
from tapewright.operators import evaluate as E
from tapewright.plans import stream_queries  # noqa: F401  registers its queries
from tapewright.plans.oracle import QUERIES
from tapewright.sources import stores as S
from tapewright.streaming import events as V
from tapewright.streaming import orders as O

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(n)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


# Share estimator


def test_prediction_takes_only_the_window(spark):
    """An old run, a gap of 38 days, a new run: two values in the window at most, so nothing is predicted with three asked for."""
    rows = [(day(d), "a", 0.5) for d in (0, 1, 2, 40, 41, 42)] + [(day(43), "a", None)]
    df = spark.createDataFrame(rows, "snapshot_date date, symbol string, proxy double")
    got = {r.snapshot_date: (r.n_prior, r.prediction) for r in B.ewma_prediction(df, 0.3, 3, 10).collect()}
    assert [got[day(d)][0] for d in (0, 1, 2, 40, 41, 42, 43)] == [0, 1, 2, 0, 1, 2, 3]
    assert [got[day(d)][1] for d in (0, 1, 2, 40, 41, 42)] == [None] * 6 and got[day(43)][1] == pytest.approx(0.5)


def test_prediction_by_loops(spark):
    rng = random.Random(4)
    rows = [(day(d), s, None if rng.random() < 0.2 else rng.uniform(0.2, 1.3)) for s in "ab" for d in sorted(rng.sample(range(80), 40))]
    df = spark.createDataFrame(rows, "snapshot_date date, symbol string, proxy double")
    got = {(r.symbol, r.snapshot_date): r for r in B.ewma_prediction(df, 0.4, 2, 9, 0.9).collect()}
    for at, s, _ in rows:
        known = [x for d, t, x in sorted(rows, key=lambda r: r[0]) if t == s and x is not None and 1 <= (at - d).days <= 9]
        want = None
        if len(known) >= 2:
            want = known[0]
            for x in known[1:]:
                want = 0.4 * x + 0.6 * want
            want = want * 0.9 if 0 < want * 0.9 <= 1 else None
        r = got[s, at]
        assert r.n_prior == len(known) and (r.prediction is None if want is None else r.prediction == pytest.approx(want))


CALIBRATION = "symbol string, snapshot_date date, eod_volume double, v_krx_1520 double, v_cons_1520 double, auction_volume double, close_krx_1519 double, close_cons_1519 double"


def calibrated(seed=1, days=16):
    rng = random.Random(seed)
    rows = []
    for s in "abc":
        for d in range(days):
            krx, auction = rng.randint(800, 1200), rng.randint(50, 200)
            rows.append((s, day(d), (krx + auction) * rng.choice([1.0, 1.01, 1.5 if d % 7 == 3 else 1.0]), float(krx), krx * rng.uniform(1.2, 1.6), float(auction), 100.0, rng.choice([100.0, 100.1, 99.8])))
    return rows


def brute_fit(rows, alphas, structures, tolerance, fraction, most):
    kept = [r for r in rows if abs(r[2] - (r[3] + r[5])) / r[2] <= tolerance]
    dates = sorted({r[1] for r in kept})
    n = math.ceil(fraction * len(dates))
    held, fit_dates = dates[:n], dates[n:]
    chosen = set(fit_dates[max(1, len(fit_dates) // 2) :])
    parts = {True: [r for r in kept if r[1] in held], False: [r for r in kept if r[1] not in held]}
    mean = statistics.fmean(r[5] / r[2] for r in parts[False])

    def raw(part, row, alpha, least, gap):
        known = [r[2] * (1 - mean) / r[4] for r in sorted(parts[part], key=lambda r: r[1]) if r[0] == row[0] and 1 <= (row[1] - r[1]).days <= gap]
        if len(known) < least:
            return None
        out = known[0]
        for x in known[1:]:
            out = alpha * x + (1 - alpha) * out
        return out

    table = []
    for a in alphas:
        for least, gap in structures:
            scope = [r for r in parts[False] if r[1] in chosen]
            raws = [(raw(False, r, a, least, gap), r[3] / r[4]) for r in scope]
            known = [(x, t) for x, t in raws if x is not None]
            bias = statistics.median(t / x for x, t in known) if known else None
            errors = [abs(x * bias - t) / t for x, t in known if 0 < x * bias <= 1]
            p90 = float(np.quantile(errors, 0.9)) if errors else math.inf
            table.append(((-len(errors) / len(scope), p90, least, -gap, a), bias))
    order, bias = min(t for t in table if t[0][1] <= most)
    scored = [(raw(True, r, order[4], order[2], -order[3]), r[3] / r[4]) for r in parts[True]]
    fine = [(x, t) for x, t in scored if x is not None and 0 < x * bias <= 1]
    errors = [abs(x * bias - t) / t for x, t in fine]
    apart = [abs(r[7] - r[6]) / r[6] * 1e4 for r in parts[True]]
    return {
        "ewma_alpha": order[4], "min_prior_days": order[2], "max_gap_days": -order[3], "bias_correction": bias, "auction_fraction_mean": mean, "n_fit_rows": len(parts[False]), "n_holdout_rows": len(parts[True]),
        "holdout_coverage": len(errors) / len(scored), "holdout_rel_err_p50": float(np.quantile(errors, 0.5)), "holdout_rel_err_p90": float(np.quantile(errors, 0.9)), "holdout_rel_err_p99": float(np.quantile(errors, 0.99)),
        "bias_holdout": statistics.median(t / x for x, t in fine), "close_bp_err_p90": float(np.quantile(apart, 0.9)), "holdout_start": held[0], "holdout_end": held[-1], "fit_start": fit_dates[0], "calibrated_through": fit_dates[-1], "n_symbols": 3,
    }


def test_estimator_fit_by_loops(spark):
    rows, alphas, structures = calibrated(), (0.2, 0.5, 0.9), ((1, 3), (2, 5), (3, 9))
    got = B.fit_estimator(spark.createDataFrame(rows, CALIBRATION), alphas, structures, 0.05, 0.4, 3, 0.9).first().asDict()
    want = brute_fit(rows, alphas, structures, 0.05, 0.4, 0.9)
    assert {k: got[k] for k in want} == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}
    assert got["alpha_at_boundary"] == (want["ewma_alpha"] in (0.2, 0.9))


def test_estimator_fit_refuses(spark):
    df = spark.createDataFrame(calibrated(2), CALIBRATION)
    for match, args in (("three distinct", ((0.2, 0.5), ((1, 3),), 0.05, 0.4, 3, 0.9)), ("structures", ((0.2, 0.5, 0.9), ((0, 3),), 0.05, 0.4, 3, 0.9)), ("fewer than", ((0.2, 0.5, 0.9), ((1, 3),), 0.05, 0.1, 9, 0.9)), ("no candidate", ((0.2, 0.5, 0.9), ((1, 3),), 0.05, 0.4, 3, 0.0)), ("out of range", ((0.2, 0.5, 0.9), ((1, 3),), 0.05, 0.8, 3, 0.9))):
        with pytest.raises(ValueError, match=match):
            B.fit_estimator(df, *args)


def test_reconstruction_refuses_late_bars(spark):
    bars = spark.createDataFrame([(DAY0, "a", h, 10.0, 8.0, 9.0, 100) for h in (151800, 152200)], "snapshot_date date, symbol string, ts_hms int, high double, low double, close double, volume long")
    share = spark.createDataFrame([(DAY0, "a", 0.5)], "snapshot_date date, symbol string, prediction double")
    r = B.reconstruct(bars.where("ts_hms < 152000"), share, 0.1, 5.0).first()
    assert (r.volume_est, r.value_est, r.volume_low, r.basis) == (50.0, 450.0, 45.0, "krx_reconstructed")
    with pytest.raises(PySparkException, match="cannot be reconstructed"):
        B.reconstruct(bars, share, 0.1, 5.0).collect()


# Order state

EVENT = "intent_id long, seq long, kind string, outcome string, qty long, filled long"


def run_orders(spark, *batches):
    """Each batch is a run of its own on the same progress: a restart lies between."""
    path, top, progress = folder() + "/in", folder() + "/out", folder()
    seen = []
    with O.rocks_store(spark):
        for rows in batches:
            df = spark.createDataFrame(rows, EVENT)
            df.write.mode("append").parquet(path)
            out = V.drain_updates(O.order_states(V.file_stream(spark, path, df.schema)), top, ["intent_id"], progress)
            seen.append({r.intent_id: (r.status, r.filled, r.reason, r.missing_seq) for r in out.collect()})
    return seen


def test_order_state_over_restarts(spark):
    full = lambda i: [(i, 0, "INTENT", None, 100, None), (i, 1, "SEND", None, 100, None), (i, 2, "RESULT", "accepted", 100, None), (i, 3, "BROKER_STATE", "final", 100, 100)]
    one, two, three, four, five = (full(i) for i in range(1, 6))
    three[3] = (3, 3, "BROKER_STATE", "final", 100, 130)
    five[2] = (5, 2, "INTENT", None, 100, None)
    a, b, c = run_orders(spark, [one[0], one[1], two[0], two[3], four[0], four[1]], [one[2], two[2], *three, four[1], *five[:3]], [one[3], two[1], four[2], five[3]])
    assert a == {1: ("UNKNOWN", 0, None, None), 2: ("RECORDED", 0, None, 1), 4: ("UNKNOWN", 0, None, None)}
    assert b[1] == ("ACKED", 0, None, None) and b[2] == ("RECORDED", 0, None, 1)
    assert b[3] == ("CORRUPT", 130, "fill beyond the quantity", None) and b[4][0] == "CORRUPT" and b[4][2] == "repeated sequence" and b[5][2] == "second intent record"
    assert c[1] == ("FILLED", 100, None, None) and c[2] == ("FILLED", 100, None, None)  # what waited is applied
    assert c[4][:1] == ("CORRUPT",) and c[5][0] == "CORRUPT" and c[3] == b[3]  # for good


def brute_orders(batches):
    """Event by event: what waits is applied once its predecessors are there."""
    known, out = {}, []
    for rows in batches:
        for i in sorted({r[0] for r in rows}):
            k = known.setdefault(i, {"next": 0, "wait": {}, "seen": [], "qty": None, "filled": None, "why": None, "intents": 0})
            for r in sorted((r for r in rows if r[0] == i), key=lambda r: r[1]):
                if r[1] < k["next"] or r[1] in k["wait"]:
                    k["why"] = k["why"] or "repeated sequence"
                else:
                    k["wait"][r[1]] = r
            while k["next"] in k["wait"]:
                _, seq, kind, outcome, qty, filled = k["wait"].pop(k["next"])
                k["next"], wrong = seq + 1, None
                k["seen"].append((seq, kind, outcome))
                k["qty"] = max((q for q in (k["qty"], qty) if q is not None), default=None)
                if kind == "INTENT":
                    k["intents"] += 1
                    wrong = "second intent record" if k["intents"] > 1 else None
                if kind == "BROKER_STATE" and filled is not None:
                    over = k["qty"] is not None and filled > k["qty"]
                    wrong = "negative fill" if filled < 0 else "fill beyond the quantity" if over else "fill decreased" if filled < (k["filled"] or 0) else None
                    k["filled"] = filled
                k["why"] = k["why"] or wrong
        out.append({i: (brute_status(k), k["filled"] or 0, k["why"], k["next"] if k["wait"] else None) for i, k in known.items()})
    return out


def brute_status(k):
    at = lambda *wanted: max((s for s, kind, outcome in k["seen"] if kind in wanted or (kind, outcome) in wanted), default=None)
    final, filled, send = at(("BROKER_STATE", "final"), ("BROKER_STATE", "cancelled")), k["filled"] or 0, at("SEND")
    if k["why"]:
        return "CORRUPT"
    if final is not None:
        return "FILLED" if k["qty"] is not None and filled >= k["qty"] else "PARTIAL" if filled > 0 else "CANCELLED" if at(("BROKER_STATE", "cancelled")) is not None else "UNFILLED"
    lost, result = at(("LOOKUP", "not_found")), at("RESULT")
    steps = (
        ("ACKED", at(("RESULT", "accepted"), ("RESULT", "adopted")) is not None),
        ("REJECTED", at(("RESULT", "rejected")) is not None),
        ("NOT_FOUND", lost is not None and lost > (-1 if send is None else send)),
        ("UNKNOWN", send is not None and (result is None or result < send)),
        ("NOT_SENT", at(*(("RESULT", o) for o in ("throttled", "auth_rejected", "not_sent"))) is not None),
        ("SKIPPED", at("SKIP") is not None),
    )
    return next((name for name, holds in steps if holds), "RECORDED")


def test_order_state_by_loops_and_without_python(spark):
    rng, rows = random.Random(6), []
    outcomes = {"RESULT": ("accepted", "adopted", "rejected", "throttled", "not_sent", "odd", None), "LOOKUP": ("not_found", "found"), "BROKER_STATE": ("final", "cancelled", "open", None)}
    for i in range(400):
        for seq in range(rng.randint(1, 7)):
            kind = "INTENT" if seq == 0 else rng.choice(["SEND", "SEND", "RESULT", "LOOKUP", "SKIP", "BROKER_STATE", "BROKER_STATE", "NOTE", "INTENT" if i % 9 == 0 else "SEND"])
            if rng.random() > 0.06:
                fill = rng.choice([None, 0, 40, 60, 100, *([130, -1] if i % 7 == 0 else [])]) if kind == "BROKER_STATE" else None
                rows += [(i, seq, kind, rng.choice(outcomes.get(kind, (None,))), rng.choice([None, 100]), fill)] * (2 if rng.random() < 0.03 else 1)
    batches = [[], [], []]
    for r in rows:
        rng.choice(batches).append(r)
    got, want = run_orders(spark, *batches), brute_orders(batches)
    assert got == want and len({v[0] for v in want[-1].values()}) == 12 and len({v[2] for v in want[-1].values()}) == 6
    plan = O.order_states(spark.createDataFrame(rows, EVENT))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and not re.search("Py(thon|Spark)|Pandas|TransformWithState", plan)


def test_order_state_refuses_rows_without_sequence(spark):
    with pytest.raises(StreamingQueryException, match="without intent or sequence"):
        run_orders(spark, [(1, None, "INTENT", None, 1, None)])


def test_late_rows_of_a_stream_equal_the_recount(spark):
    rng = random.Random(2)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=10 * k - rng.choice([0, 0, 5, 30, 60]), minutes=rng.randint(0, 59))
    rows = [(k * 100 + i, at(k), k) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, batch int")
    path = folder() + "/in"
    for k in range(5):
        df.where(F.col("batch") == k).coalesce(1).write.mode("append").parquet(path)
    got = V.late_in_stream(V.file_stream(spark, path, df.schema, 1), "20 hours", folder()).first()
    want = V.late_by_batch(df, "20 HOURS").first()
    assert got == want and 0 < got.n_late < 100


def test_late_rows_of_tied_arrivals_come_by_id(spark):
    rows = [(3 + 10007 * k, dt.datetime(2024, 1, 1, 2 * k)) for k in range(5)] + [(4 + 10007 * k, dt.datetime(2024, 1, 2, 10 - 2 * k)) for k in range(5)]
    for order in (rows, rows[::-1]):
        top = folder()
        spark.createDataFrame(order, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{top}/events.parquet")
        assert sorted((r.day.day, r.n, r.n_late) for r in QUERIES["t3_late_rows"](spark, top).collect()) == [(1, 5, 0), (2, 5, 4)]


# Stores


def test_patch_tells_columns_apart(spark):
    base = spark.createDataFrame([(1, None, 5), (2, None, None), (3, 1, 1)], "k int, a int, b int")
    now = spark.createDataFrame([(1, 5, None), (2, None, None), (4, 1, 1)], "k int, a int, b int")
    changed, deleted = S.make_patch(base, now, ["k"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, 5, None), (4, 1, 1)] and [r.k for r in deleted.collect()] == [3]


def test_monthly_base_and_three_patches(spark):
    rng = random.Random(3)
    rows = {(day(d), s): rng.choice([None, 1.0, 2.5]) for d in range(0, 90, 3) for s in "ab"}
    schema = "date date, symbol string, close double, volume double"
    table = lambda m: spark.createDataFrame([(*k, v, None if v else 7.0) for k, v in m.items()], schema)
    top = folder()
    S.write_base(table(rows), top, ["symbol", "date"])
    for number in range(3):
        for k in rng.sample(sorted(rows), 6):
            rows[k] = rng.choice([None, 9.0])
        rows.pop(rng.choice(sorted(rows)))
        rows[day(200 + number), "c"] = None
        S.write_patch(table(rows), top, ["symbol", "date"], number)
        built = S.rebuilt(spark, top, ["symbol", "date"], table(rows).schema, number)
        assert sorted(map(str, built.collect())) == sorted(map(str, table(rows).collect()))
    assert spark.read.parquet(f"{top}/patch=0/rows").count() < 12  # what changed, not the table
    spark.read.parquet(f"{top}/base/_month=202402").limit(3).write.mode("append").parquet(f"{top}/base/_month=202402")
    with pytest.raises(ValueError, match="month 202402"):
        S.read_base(spark, top, table(rows).schema)
    with pytest.raises(ValueError, match="no date"):
        S.write_base(table({(None, "a"): 1.0}), folder(), ["symbol"])


# Attribution

POOL = "date date, symbol string, close double, next_date date, next_open double, next_high double, next_close double, cost_bp double, pred double, admitted boolean, selected boolean, model_version string"


def pool_row(d, s, to, pred, selected, high=None, next_day=True, close=None):
    return (day(d), s, 100.0, day(d + 1) if next_day else None, to, high if high is not None else to, close if close is not None else to, 10.0, pred, True, selected, "v1")


def test_attribution_by_hand(spark):
    rows = [pool_row(0, s, to, p, sel) for s, to, p, sel in (("a", 101.0, 0.4, True), ("b", 102.0, 0.3, True), ("c", 99.0, 0.2, False), ("d", 98.0, 0.1, False))]  # settled
    rows[1] = pool_row(0, "b", 102.0, 0.3, True, high=107.0, close=90.0)  # the take-profit is touched
    rows += [pool_row(1, "a", 101.0, 0.4, True), pool_row(1, "b", None, 0.3, True), pool_row(1, "c", 103.0, 0.2, False)]  # a pick without an exit
    rows += [pool_row(2, "a", 101.0, 0.4, True), pool_row(2, "b", None, 0.3, True, next_day=False)]  # pending
    rows += [pool_row(3, "a", 150.0, 0.4, True), pool_row(3, "b", 101.0, 0.3, True)]  # a split
    df = spark.createDataFrame(rows, POOL)
    status = {(r.date, r.symbol): r.status for r in A.exit_arms(df).collect()}
    assert status[day(3), "a"] == "PRICE_DISCONTINUITY" and status[day(1), "b"] == "NO_EXIT" and status[day(2), "b"] == "PENDING"
    got = {r.date: r for r in A.daily_ledger(A.exit_arms(df)).collect()}
    r = got[day(0)]
    assert (r.day_status, r.n_pool, r.n_selected_realized) == ("SETTLED", 4, 2)
    assert r.selected_open_net == pytest.approx(0.015 - 0.001) and r.selected_tp_net == pytest.approx((0.01 + 0.05) / 2 - 0.001) and r.admitted_open_net == pytest.approx(-0.001)
    assert r.selection_edge_net == pytest.approx(0.015) and r.ic_pool_net == pytest.approx(0.8)
    assert got[day(1)].selected_open_net is None and got[day(1)].admitted_open_net == pytest.approx(0.02 - 0.001) and got[day(1)].ic_pool_net is None  # a part of a basket is none; two names are too few
    assert got[day(2)].day_status == "PENDING" and got[day(2)].selected_open_net is None and got[day(2)].n_pool_realized == 1
    assert got[day(3)].selected_open_net is None and got[day(3)].n_selected_realized == 1
    s = A.ledger_summary(A.daily_ledger(A.exit_arms(df))).first()
    assert s.exit_compare_days == 1 and s.tp_minus_open_mean_bp == pytest.approx(150.0) and s.tp_minus_open_t is None and s.ic_pool_net_days == 1
    with pytest.raises(PySparkException, match="a name twice"):
        A.exit_arms(df.unionByName(df.limit(1))).collect()
    with pytest.raises(PySparkException, match="two model versions"):
        A.daily_ledger(A.exit_arms(df.withColumn("model_version", F.col("symbol")))).collect()


# Certification


def test_certification_by_hand(spark):
    rows = [(day(0), "full", s, p, n) for s, p, n in (("a", 0.9, 0.01), ("b", 0.8, 0.02), ("c", 0.7, None), ("d", 0.1, -0.01))]
    rows += [(day(0), "thin", s, p, n) for s, p, n in (("b", 0.9, 0.02), ("d", 0.8, -0.01), ("c", 0.7, None))]
    rows += [(day(1), "full", "a", 0.9, 0.01), (day(1), "full", "b", 0.8, 0.03), (day(1), "thin", "a", 0.9, None), (day(1), "thin", "b", 0.8, 0.02)]  # void: one known result in thin
    rows += [(day(2), "full", "a", 0.9, 0.01), (day(2), "full", "b", 0.8, 0.03)]  # void: no thin at all
    got = {(r.date, r.arm): r for r in K.certification_daily(spark.createDataFrame(rows, "date date, arm string, symbol string, pred double, net double"), "full", 2, least_names=3).collect()}
    f, t = got[day(0), "full"], got[day(0), "thin"]
    assert f.topk_net_bp == pytest.approx(150.0) and f.overlap == 1.0 and f.n_pool == 4 and f.rank_ic == pytest.approx(0.5)
    assert t.topk_net_bp == pytest.approx(50.0) and t.overlap == 0.5 and t.rank_ic == pytest.approx(1.0)
    for d in (1, 2):
        for arm in ("full", "thin"):
            r = got[day(d), arm]
            assert (r.topk_net_bp, r.rank_ic, r.overlap) == (None, None, None)
    assert got[day(1), "thin"].n_pool == 2 and got[day(2), "thin"].n_pool == 0


def test_intervals_by_group_equal_those_of_each_group(spark):
    rng = random.Random(1)
    rows = [(g, day(d), rng.gauss(0.01 * (g == "a"), 0.02)) for g, n in (("a", 60), ("b", 45), ("c", 4)) for d in range(n)]
    df = spark.createDataFrame(rows, "arm string, date date, net double")
    got = {r.arm: r for r in E.block_bootstrap(df, by=("arm",), reps=80).collect()}
    assert set(got) == {"a", "b"}  # c is shorter than a block
    for g in "ab":
        alone = E.block_bootstrap(df.where(F.col("arm") == g), reps=80).first()
        assert (got[g].low, got[g].high, got[g].p_value) == pytest.approx((alone.low, alone.high, alone.p_value)) and got[g].low < got[g].high
    daily = spark.createDataFrame([(day(d), arm, x) for d in range(40) for arm, x in (("full", 5.0 + d % 3), ("thin", 4.0), ("short", 1.0 if d < 9 else None))], "date date, arm string, topk_net_bp double")
    out = {r.arm: r for r in K.paired_deltas(daily, "full", reps=50).collect()}
    assert out["thin"].n_days == 40 and out["thin"].mean_delta == pytest.approx(sum(1 + d % 3 for d in range(40)) / 40) and out["thin"].low > 0
    assert out["short"].n_days == 9 and out["short"].low is None


def test_leaderboard_deflates_by_the_trials_of_the_period(spark):
    rng = random.Random(5)
    daily = spark.createDataFrame([(p, t, day(d), rng.gauss(0.002 * t, 0.01)) for p, ts in ((1, (1, 2, 3)), (2, (1,))) for t in ts for d in range(50)], "period int, trial int, date date, net double")
    records = spark.createDataFrame([(1, 1, day(1), 0, "old"), (1, 1, day(2), 0, "new"), (1, 2, day(1), 0, "x"), (1, 3, day(1), 0, "x"), (1, 4, day(1), 0, "none"), (2, 1, day(1), 0, "x")], "period int, trial int, recorded date, seq int, note string")
    got = {(r.period, r.trial): r for r in K.leaderboard(records, daily).collect()}
    assert got[1, 1].note == "new" and got[1, 2].n_trials == 4 and got[2, 1].n_trials == 1 and got[1, 4].dsr == 0.0 and got[1, 4].place == 4
    for p, t, n in ((1, 3, 4), (2, 1, 1)):
        alone = E.deflated_sharpe(daily.where((F.col("period") == p) & (F.col("trial") == t)), n).first()
        assert got[p, t].dsr == pytest.approx(alone.dsr)


def test_stress_wants_mean_and_median(spark):
    rows = spark.createDataFrame([(day(d), g, 0.0, 0.0, 0.0) for d, g in enumerate((-0.01, -0.01, 0.05))], "date date, gross double, tax double, tick_cost_bp double, fee double")
    assert [r.passes for r in E.stress(rows, (2.0,)).collect()] == [False]
    assert [r.passes for r in E.stress(rows.withColumn("gross", F.abs("gross")), (2.0,)).collect()] == [True]


def test_verdict_in_order(spark):
    metrics = lambda post_cover, median, t: spark.createDataFrame([("pre_reform", -0.01, -0.01, -1.0, "INSUFFICIENT_COVERAGE", 0.2), ("post_reform", 0.01, median, t, post_cover, 0.95), ("full_history", 0.005, 0.01, 1.0, "OK", 0.95)], "regime string, mean double, median double, t double, coverage_status string, feasible_day_fraction double")
    stress = lambda ok: spark.createDataFrame([(2.0, True), (3.0, ok)], "ticks double, passes boolean")
    verdict = lambda *a: tuple(K.cost_verdict(metrics(*a[:3]), stress(a[3])).first())
    head = "pre_reform not gate-eligible; full_history for transparency only"
    assert verdict("OK", 0.01, 2.5, True) == ("PASS_POST_REFORM", head)
    assert verdict("OK", -0.01, 1.5, False) == ("FAIL", head + "; failed gate: post_reform_median_positive; failed gate: post_reform_t_stat; failed gate: post_reform_3tick_stress")
    assert verdict("INSUFFICIENT_COVERAGE", 0.01, 2.5, True) == ("INSUFFICIENT_COVERAGE", head + "; post_reform INSUFFICIENT_COVERAGE: statistics not evaluated")
    none = K.regime_metrics(spark.createDataFrame([], "date date, net double"), spark.createDataFrame([], "date date, feasible boolean"))
    assert K.cost_verdict(none, stress(True)).first().verdict == "INSUFFICIENT_COVERAGE" and none.count() == 3


def test_constructibility_gate(spark):
    rows = spark.createDataFrame([(dt.date(2022, 1, 3), "a")] + [(day(d), s) for d in range(20) for s in "abc"[: 2 if d == 0 else 3]], "date date, symbol string")
    assert K.constructible(rows, 3).first().share == pytest.approx(0.95)
    for frame, regimes in ((rows, ("pre_reform",)), (rows.limit(0), ("post_reform",)), (rows.where("date > '2023-01-25' and symbol <> 'c'"), ("post_reform",))):
        with pytest.raises(PySparkException, match="not constructible"):
            K.constructible(frame, 3, regimes=regimes).collect()


def test_training_weights(spark):
    cal = spark.createDataFrame([(day(d),) for d in (0, 1, 4, 5, 8)], "date date")  # sessions
    rows = spark.createDataFrame([(day(d),) for d in (0, 1, 2, 4, 5, 8)], "date date")
    got = {r.date: r.weight for r in K.age_weights(rows, cal, str(day(6)), 2.0).collect()}  # four sessions are before day 6
    assert got == {day(d): pytest.approx(0.5 ** (a / 2)) for d, a in ((0, 4), (1, 3), (2, 2), (4, 2), (5, 1), (8, 0))}
    pool = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 1.0), (day(0), "c", None), (day(1), "a", 5.0), (day(1), "b", 3.0), (day(1), "c", 4.0)], "date date, symbol string, y double")
    grades = {(r.date, r.symbol): r.grade for r in K.ranking_grades(pool, "y", 3).collect()}
    assert grades == {(day(0), "a"): 0, (day(0), "b"): 1, (day(0), "c"): None, (day(1), "b"): 0, (day(1), "c"): 1, (day(1), "a"): 2}
    two = pool.where("not (date = date'2024-01-01' and symbol = 'c')")  # two rows, then three
    flat = {r.date: r.weight for r in K.balanced_weights(two).collect()}
    assert flat[day(0)] * 2 == pytest.approx(flat[day(1)] * 3) and flat[day(0)] * 2 + flat[day(1)] * 3 == pytest.approx(5.0)
    aged = {r.date: r.weight for r in K.balanced_weights(two, "current", 252).collect()}
    assert aged[day(0)] / aged[day(1)] == pytest.approx(0.5 ** (1 / 252)) and sum(aged.values()) == pytest.approx(2.0)
    assert {r.weight for r in K.balanced_weights(two, "current").collect()} == {None}
    with pytest.raises(ValueError):
        K.balanced_weights(two, "other")
