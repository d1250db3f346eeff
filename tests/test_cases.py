"""Hand-computed cases: scenario ladder, rank IC, buyability, vendors, averages, auctions, the upsert sink."""

import datetime as dt
import math
import random
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapewright.functions.windows import numbered, text_draw
from tapewright.operators import bars as B
from tapewright.operators import evaluate as E
from tapewright.operators import features as X
from tapewright.operators import ledgers as G
from tapewright.operators import models as L
from tapewright.operators import normalize as N
from tapewright.operators import universe as U
from tapewright.sources import stores as S
from tapewright.streaming import events as V

DAY0 = dt.date(2024, 1, 1)


def panel(spark, rows):
    """rows: symbol, day number, open, high, low, close, volume, chg_ratio"""
    found = [(s, DAY0 + dt.timedelta(d), float(o), float(h), float(lo), float(c), float(v), x) for s, d, o, h, lo, c, v, x in rows]
    return spark.createDataFrame(found, "symbol string, date date, open double, high double, low double, close double, volume double, chg_ratio double")


def flat(s, days, price=100, volume=100):
    return [(s, d, price, price + 50, price - 50, price, volume, 0.0) for d in range(days)]


def test_scenario_ladder_by_hand(spark):
    """A row for each rung; the background is flat, with highs far above the close, so that no other rung holds."""
    last = {
        "A": [*flat("A", 70), ("A", 70, 100, 129, 99, 129, 100, 0.29), ("A", 71, 129, 150, 100, 125, 100, -0.03)],  # a ceiling the row before
        "B": [*flat("B", 70), ("B", 70, 100, 114, 90, 113, 100, 0.13)],  # closes near the high, up 13 %
        "C": [*flat("C", 70), ("C", 70, 110, 120, 99, 101, 100, 0.01)],  # up, but low in its range
        "D": [*flat("D", 70), ("D", 70, 100, 150, 70, 149, 100, -0.01)],  # 149 / 150
        "E": [*flat("E", 70), ("E", 70, 100, 150, 70, 140, 100, -0.01)],  # 140 / 150
        "F": [*flat("F", 70), ("F", 70, 100, 150, 70, 101, 100, -0.01)],  # crosses MA120, which the row before was at
        "G": [*flat("G", 70), ("G", 70, 100, 150, 70, 139, 1500, -0.01)],  # far over MA20 with volume; near the high is earlier
        "H": [*flat("H", 70), ("H", 70, 100, 150, 70, 99, 600, -0.01)],  # volume: mean of 5 is 200, of 20 is 125
        "I": [*flat("I", 70), ("I", 70, 100, 150, 70, 99, 100, -0.01)],
    }
    got = {r.symbol: r.scenario for r in X.scenario_ladder(panel(spark, [r for rows in last.values() for r in rows])).groupBy("symbol").agg(F.max_by("scenario", "date").alias("scenario")).collect()}
    want = dict(zip("ABCDEFGHI", ["상한가 다음날", "상따", "상승형 음봉", "신고가", "신고가 근접", "120 돌파", "120 돌파", "거래량 폭증", "미분류"], strict=True))
    assert got == want
    frame = {r.symbol: r for r in X.scenario_frame(panel(spark, last["H"])).where(F.col("date") == DAY0 + dt.timedelta(70)).collect()}["H"]
    assert frame.vol_ratio_5_20 == pytest.approx(200 / 125) and frame.high_252d_ratio == pytest.approx(99 / 150) and frame.close_pos == pytest.approx(29 / 80)
    # Overheated: over MA20 by more than 35 % and volume at 2.3 times, below MA120's cross and the high's 93 %.
    hot = [*flat("J", 60, 200), *[("J", d, 100, 250, 50, 100, 100, 0.0) for d in range(60, 100)], ("J", 100, 140, 250, 100, 145, 4000, -0.01)]
    assert X.scenario_ladder(panel(spark, hot)).agg(F.max_by("scenario", "date")).first()[0] == "과열"


def test_action_panel_stops_on_two_versions(spark):
    rows = spark.createDataFrame([("2024-01-01", "a", X.SCENARIOS[1], 1), ("2024-01-01", "a", X.SCENARIOS[1], 1), ("2024-01-01", "a", X.SCENARIOS[3], 1)], "date string, symbol string, scenario string, v int")
    one = X.action_panel(rows).first()
    assert (one.is_chase, one.is_new_high, one.is_near_high, one.n_scenarios) == (1, 1, 0, 2)
    with pytest.raises(PySparkException, match="two versions"):
        X.action_panel(rows.unionByName(rows.withColumn("v", F.lit(2)))).collect()


def test_rank_ic_needs_whole_dates(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", None, 3.0), ("c", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0), ("e", float("nan"), 1.0), ("e", 2.0, 2.0), ("f", 1.0, 5.0), ("f", 1.0, 6.0), ("f", 2.0, 7.0)]
    got = {r.date: (r.n, r.ic) for r in E.rank_ic(spark.createDataFrame(rows, "date string, s double, t double"), "s", "t").collect()}
    assert set(got) == {"a", "f"} and got["a"] == (3, pytest.approx(0.5)) and got["f"] == (3, pytest.approx(math.sqrt(3) / 2))


def test_buyability_by_hand(spark):
    rows = spark.createDataFrame([("d", s, c, p, h) for s, c, p, h in (("a", 129.0, 100.0, 129.0), ("b", 129.0, 100.0, 130.0), ("c", 100.0, 0.0, 100.0), ("e", 100.0, 100.0, 100.0))], "date string, symbol string, close double, prev_close double, high double")
    liquid = spark.createDataFrame([("d", "a", 5e7), ("d", "b", 2e8), ("d", "c", None)], "date string, symbol string, auction_value double")
    got = {r.symbol: (r.fill_ratio, r.buyable, r.ceiling_entry, r.auction_found) for r in U.buyability(rows, liquid, 1e7).collect()}
    assert got == {"a": (pytest.approx(0.5), False, True, True), "b": (1.0, True, False, True), "c": (None, False, False, True), "e": (None, True, False, False)}
    strict = U.buyability(rows, liquid, 1e7, least_fill=0.5, require_data=True)
    assert {r.symbol: r.buyable for r in strict.collect()} == {"a": True, "b": True, "c": False, "e": False}
    r = U.buyability_report(U.buyability(rows, liquid, 1e9)).first()
    assert (r.n_rows, r.n_ceiling, r.n_unmeasured, r.n_blocked, r.blocked_median, r.blocked_p25) == (4, 1, 1, 3, 1.25e8, 8.75e7)
    for bad in ({"order_value": 0.0}, {"order_value": 1e6, "participation": 1.5}):
        with pytest.raises(ValueError):
            U.buyability(rows, liquid, **bad)


def test_unknown_weights_buy_nothing(spark):
    picks = spark.createDataFrame([("2024-01-02", "a", None, 100.0, "KOSPI"), ("2024-01-02", "b", 0.5, 100.0, "KOSPI")], "date string, symbol string, weight double, close_raw double, market string").withColumn("date", F.to_date("date"))
    assert {r.symbol: r.qty for r in U.position_size(picks, 10_000.0).collect()} == {"a": None, "b": 40}


def test_vendor_text_that_is_no_number_is_null(spark):
    raw = spark.createDataFrame([("d", "5930", "20240102", "090100", "-", "10", "9", "10", "x")], "snapshot_date string, symbol string, Date string, Hour string, Oprc string, Hprc string, Lprc string, Prpr string, CntgVol string")
    r = N.vendor_bars(raw, "dbsec").first()
    assert (r.symbol, r.ts_hms, r.open, r.high, r.volume, r.value_krw, r.has_trade, r.vendor) == ("005930", 90100, None, 10.0, None, None, False, "dbsec")


def test_auction_fills_by_hand(spark):
    at = lambda h: dt.datetime(2024, 1, 2, h)
    orders = spark.createDataFrame([("a", "auction_close", at(15)), ("b", "auction_close", at(15)), ("c", "auction_open", at(8)), ("d", "auction_open", at(8)), ("e", "auction_close", at(15))], "order_id string, rule string, placed_at timestamp")
    seen = spark.createDataFrame([("a", 100.0, at(16), True), ("b", 100.0, at(16), None), ("c", 50.0, at(9), None), ("d", 0.0, at(9), None)], "order_id string, auction_price double, observed_at timestamp, confirmed boolean")
    assert {r.order_id: (r.price, r.status) for r in G.auction_fills(orders, seen).collect()} == {"a": (100.0, "FILLED"), "b": (None, "UNFILLED"), "c": (50.0, "FILLED"), "d": (None, "UNFILLED"), "e": (None, "UNFILLED")}
    for bad in (seen.withColumn("observed_at", F.lit(at(1))), seen.withColumn("auction_price", F.lit(-1.0))):
        with pytest.raises(PySparkException, match="an auction before its order|a confirmed close"):
            G.auction_fills(orders, bad).collect()


def test_exit_without_entry_fails(spark):
    fills = spark.createDataFrame([("x:1", "x", "s", "sell", 5, 11.0, DAY0)], "order_id string, entry_order_id string, symbol string, side string, qty long, fill_price double, filled_on date")
    with pytest.raises(PySparkException, match="an exit without an entry"):
        G.round_trips(fills).collect()


def test_upsert_sink_goes_on_from_its_folder(spark):
    top = "file://" + tempfile.mkdtemp(prefix="spark-") + "/table"
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert V.upserted(spark, top) is None
    V.upsert_to(top, ["k"], 4)(batch([(1, "a"), (2, "a"), (3, "a")]), 0)
    V.upsert_to(top, ["k"], 4)(batch([(2, "b"), (9, "b")]), 1)  # another sink, as after a restart
    V.upsert_to(top, ["k"], 4)(batch([(2, "b"), (9, "b")]), 1)  # the same epoch again
    assert {(r.k, r.v) for r in V.upserted(spark, top).collect()} == {(1, "a"), (2, "b"), (3, "a"), (9, "b")}


def test_upsert_sink_deletes_replaced_versions_and_grows(spark):
    import os

    folder = tempfile.mkdtemp(prefix="spark-") + "/table"
    top, want, rng = "file://" + folder, {}, random.Random(3)
    batch = lambda rows: spark.createDataFrame(rows, "k long, v int")
    kept = lambda: [d for d, _, _ in os.walk(folder) if "_bucket=" in d]
    for epoch in range(6):
        rows = {rng.choice([None, *range(12)]): epoch for _ in range(4)}
        want |= rows
        for _ in range(2):  # each epoch runs again, as after a crash before its commit
            V.upsert_to(top, ["k"], 2, keep=1)(batch(list(rows.items())), epoch)
        assert {r.k: r.v for r in V.upserted(spark, top).collect()} == want
        assert len(kept()) <= 4  # the last version of two buckets, and the epoch's own
    V.upsert_to(top, ["k"], 2, keep=1)(batch([]), 6)
    assert {r.k: r.v for r in V.upserted(spark, top).collect()} == want
    sink = V.upsert_to(top, ["k"], 2, bucket_rows=5, keep=1)
    sink(batch([(100 + i, 7) for i in range(20)]), 7)  # more than ten rows: dealt anew
    want |= {100 + i: 7 for i in range(20)}
    assert {d.split("_buckets=")[1].split("/")[0] for d in kept() if "_epoch=7" in d} == {"8"}
    os.remove(f"{folder}/_epoch=7/_buckets=8/_SUCCESS")  # the epoch did not finish: readers see the one before, and it runs again
    assert 100 not in {r.k for r in V.upserted(spark, top).collect()}
    sink(batch([(100 + i, 7) for i in range(20)]), 7)
    assert {r.k: r.v for r in V.upserted(spark, top).collect()} == want
    sink(batch([(0, 8)]), 8)
    want[0] = 8
    rows = V.upserted(spark, top).collect()
    assert {r.k: r.v for r in rows} == want and len(rows) == len(want)
    assert {d.split("_buckets=")[1].split("/")[0] for d in kept()} == {"8"}  # those of fewer buckets are gone


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_path(Cluster, "x")


def test_numbers_run_over_days_and_draws_are_md5(spark):
    import hashlib

    df = spark.createDataFrame([(d, s) for d in (3, 1, 2) for s in ("b", "a")], "day int, name string")
    got = [(r.day, r.name, r.at) for r in numbered(df, "day", "name", "at").orderBy("at").collect()]
    assert got == [(d, s, 2 * i + j) for i, d in enumerate((1, 2, 3)) for j, s in enumerate(("a", "b"))]
    assert df.select(text_draw(F.lit("x"), F.lit(7)).alias("u")).first().u == int(hashlib.md5(b"x:7").hexdigest()[:8], 16)


def test_tiers_take_the_first_that_has_a_key(spark):
    tier = lambda rows: spark.createDataFrame(rows, "date string, symbol string, v int")
    got = L.tiered_dataset([("live", tier([("d", "a", 1)])), ("eod", tier([("d", "a", 2), ("d", "b", 3)]))]).collect()
    assert {(r.symbol, r.v, r.tier) for r in got} == {("a", 1, "live"), ("b", 3, "eod")}


def test_platt_learns_from_both_sides_of_the_split(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        rows.append((DAY0 + dt.timedelta(i % 40), x, float(rng.random() < 1 / (1 + math.exp(-2 * x)))))
    df = spark.createDataFrame(rows, "date date, x double, won double")
    got = L.platt(df, ["x"], "won", "2024-01-20").collect()
    assert len(got) == 400 and all(0 < r.probability < 1 for r in got)
    order = sorted(got, key=lambda r: r.x)
    assert order[0].probability < 0.2 < 0.8 < order[-1].probability and order == sorted(got, key=lambda r: (r.raw, r.x))
    turned = df.withColumn("won", F.when(F.col("date") < "2024-01-20", 1 - F.col("won")).otherwise(F.col("won")))  # the classifier learns the reverse, the curve turns it back
    again = {r.x: r.probability for r in L.platt(turned, ["x"], "won", "2024-01-20").collect()}
    assert all(abs(again[r.x] - r.probability) < 0.05 for r in got)
