"""Event logs folded to state: orders, lots, round trips, attempts, audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tapewright.functions import market as M
from tapewright.sources.stores import shared_path


def order_state(events: DataFrame, check_seq: bool = True) -> DataFrame:
    """G1: a row for each intent: status by priority, filled quantity, number of sends.

    events: intent_id, seq, kind, outcome, qty, filled. One aggregation: the
    last sequence of each kind of evidence decides, highest priority first. A
    stream can't count distinct sequences: check_seq=False leaves that out.
    """
    last = lambda cond: F.max(F.when(cond, F.col("seq")))
    kind, outcome = F.col("kind"), F.col("outcome")
    final = (kind == "BROKER_STATE") & (outcome == "final")
    cancelled = (kind == "BROKER_STATE") & (outcome == "cancelled")
    g = events.groupBy("intent_id").agg(
        F.max("qty").alias("qty"),
        F.count_if(kind == "SEND").alias("n_sends"),
        last(kind == "SEND").alias("send"),
        last(kind == "RESULT").alias("result"),
        last(final | cancelled).alias("final"),
        F.max_by("filled", F.when(final | cancelled, F.col("seq"))).alias("filled"),
        last(cancelled).alias("cancelled"),
        last((kind == "RESULT") & outcome.isin("accepted", "adopted")).alias("ack"),
        last((kind == "RESULT") & (outcome == "rejected")).alias("rejected"),
        last((kind == "LOOKUP") & (outcome == "not_found")).alias("not_found"),
        last((kind == "RESULT") & outcome.isin("throttled", "auth_rejected", "not_sent")).alias("not_sent"),
        last(kind == "SKIP").alias("skip"),
        *([F.count("*").alias("n_events"), F.count_distinct("seq").alias("n_seq")] if check_seq else []),
    )
    filled = F.coalesce("filled", F.lit(0))
    status = (
        F.when(F.col("final").isNotNull(), F.when(filled >= F.col("qty"), "FILLED").when(filled > 0, "PARTIAL").when(F.col("cancelled").isNotNull(), "CANCELLED").otherwise("UNFILLED"))
        .when(F.col("ack").isNotNull(), "ACKED")
        .when(F.col("rejected").isNotNull(), "REJECTED")
        .when(F.col("not_found") > F.coalesce("send", F.lit(-1)), "NOT_FOUND")
        .when(F.col("send").isNotNull() & (F.col("result").isNull() | (F.col("result") < F.col("send"))), "UNKNOWN")
        .when(F.col("not_sent").isNotNull(), "NOT_SENT")
        .when(F.col("skip").isNotNull(), "SKIPPED")
        .otherwise("RECORDED")
    )
    out = g.select("*", status.alias("status"), filled.cast("long").alias("_filled"))
    again = [(F.col("n_events") != F.col("n_seq")).alias("repeated_seq")] if check_seq else []
    return out.select("intent_id", "status", F.col("_filled").alias("filled"), "n_sends", *again)


def open_lots(fills: DataFrame) -> DataFrame:
    """What is left of each entry after its exits."""
    entry = fills.where("side = 'buy'").groupBy("order_id", "symbol").agg(F.sum("qty").alias("bought"), F.min("filled_on").alias("since"))
    sold = fills.where("side = 'sell'").groupBy(F.col("entry_order_id").alias("order_id")).agg(F.sum("qty").alias("sold"))
    return entry.join(sold, "order_id", "left").withColumn("open_qty", F.col("bought") - F.coalesce("sold", F.lit(0))).where("open_qty > 0").drop("bought", "sold")


def broker_matches(intents: DataFrame, orders: DataFrame, bound: DataFrame, baseline: DataFrame) -> DataFrame:
    """Broker orders that could be an intent's: same name, side, quantity and limit, not bound, not there before.

    Ids that are out go together, as ids alone. There is a row for each pair of
    equal terms, so that the result grows with the square of the tables.
    """
    gone = bound.select("broker_id").unionByName(baseline.select("broker_id"))
    free = orders.join(gone, "broker_id", "left_anti")
    return intents.join(free, ["symbol", "side", "qty", "limit_price"]).select("intent_id", "broker_id")


def reconcile(intents: DataFrame, orders: DataFrame) -> DataFrame:
    """Both sides by intent id, with a class, and how many of each."""
    a = intents.select("intent_id", F.col("qty").alias("want"))
    b = orders.select("intent_id", F.col("qty").alias("have"))
    kind = F.when(F.col("have").isNull(), "missing_at_broker").when(F.col("want").isNull(), "unknown_order").when(F.col("want") != F.col("have"), "quantity").otherwise("matched")
    return a.join(b, "intent_id", "full").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def round_trips(fills: DataFrame) -> DataFrame:
    """Each exit with its entry: fees, floored tax by the exit's date, net, carry days. An exit without an entry fails the job.

    An entry and its exits meet in one window by the entry's id; fills are read and sent once.
    """
    buy = F.col("side") == "buy"
    trip = F.when(buy, F.col("order_id")).otherwise(F.col("entry_order_id"))
    opened = F.first(F.when(buy, F.struct("symbol", F.col("fill_price").alias("entry_price"), F.col("filled_on").alias("entry_on"), F.col("qty").alias("entry_qty"))), True).over(W.partitionBy("_trip"))
    met = fills.where("side in ('buy', 'sell')").withColumn("_trip", trip).withColumn("_entry", opened).where(~buy)
    known = F.when(F.col("_entry").isNull(), F.raise_error(F.concat(F.lit("an exit without an entry: "), F.col("order_id")))).otherwise(F.col("_entry"))
    j = met.withColumn("_entry", known).select("order_id", "entry_order_id", "qty", "fill_price", "filled_on", "_entry.*")
    notional, cost = F.col("fill_price") * F.col("qty"), F.col("entry_price") * F.col("qty")
    out = j.withColumn("tax", F.floor(notional * M.tax_bp(F.col("filled_on")) / 1e4)).withColumn("fee", (notional + cost) * M.FEE_BP / 2 / 1e4)
    return out.withColumn("net_pnl", notional - cost - F.col("tax") - F.col("fee")).withColumn("net_ret", F.col("net_pnl") / cost).withColumn("carry_days", F.datediff("filled_on", "entry_on"))


def nav_snapshot(fills: DataFrame, marks: DataFrame, cash: float) -> DataFrame:
    """Cash, cost basis and market value of what is open, and names without a mark."""
    flow = fills.agg((F.lit(cash) - F.sum(F.when(F.col("side") == "buy", F.col("qty") * F.col("fill_price")).otherwise(-F.col("qty") * F.col("fill_price")))).alias("cash"))
    lots = open_lots(fills).join(fills.where("side = 'buy'").select("order_id", "fill_price"), "order_id").join(marks, "symbol", "left")
    held = lots.agg(F.coalesce(F.sum(F.col("open_qty") * F.col("fill_price")), F.lit(0.0)).alias("cost_basis"), F.coalesce(F.sum(F.col("open_qty") * F.coalesce("mark", "fill_price")), F.lit(0.0)).alias("market_value"), F.count_if(F.col("mark").isNull()).alias("n_unmarked"))
    return flow.crossJoin(held).withColumn("nav", F.col("cash") + F.col("market_value"))


def effective_fills(fills: DataFrame, voids: DataFrame) -> DataFrame:
    """G7"""
    return fills.join(voids.select("order_id").distinct(), "order_id", "left_anti")


def _first_within(values: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query the first place from `start` on whose value is at most `limit`; len(values) if there is none."""
    least, size = [values], 1  # minima of 1, 2, 4 .. values from each place on
    while 2 * size <= len(values):
        least.append(np.minimum(least[-1][:-size], least[-1][size:]))
        size *= 2
    at = start.copy()
    for table in reversed(least):
        if len(table):
            whole = at < len(table)
            at += np.where(whole & (table[np.minimum(at, len(table) - 1)] > limit), size, 0)
        size //= 2
    return at


def _fill_side(values: np.ndarray, start: np.ndarray, side: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """_first_within for buys (1: at or under the limit), sells (-1: at or over it) and market orders (0: any); values: (least, most) a place."""
    low, high = values
    return np.where(side < 0, _first_within(-high, start, -limit), _first_within(low, start, np.where(side == 0, np.inf, limit)))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what is used more than once is made once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _seek(asks: DataFrame, nodes: DataFrame, keys: Sequence[str], after: str) -> DataFrame:
    """asks with the other columns of the first node beyond `after`, of those with the same keys, that suits kind and limit; NULL if there is none.

    nodes: keys, place, low, high and others.
    """
    held, carried = asks.columns, [c for c in nodes.columns if c not in (*keys, "low", "high")]

    def first(asked, there):
        there = there.sort_by("place")
        found = _fill_side((there["low"].to_numpy(), there["high"].to_numpy()), np.searchsorted(there["place"].to_numpy(), asked[after].to_numpy(), side="right"), asked["kind"].to_numpy(), asked["limit"].to_numpy())
        take = pa.array(found, mask=found >= there.num_rows)
        return pa.table({c: asked[c] for c in held} | {c: there[c].take(take) for c in carried})

    schema = T.StructType([*asks.schema.fields, *(nodes.schema[c] for c in carried)])
    named = nodes.withColumnsRenamed({k: f"of_{k}" for k in keys})  # both sides may come from one table
    return asks.groupBy(*keys).cogroup(named.groupBy(*(f"of_{k}" for k in keys))).applyInArrow(first, schema)


def fill_decision(orders: DataFrame, prints: DataFrame, rows: int = 4000) -> DataFrame:
    """The first print after placement that the order's rule lets fill it.

    orders: order_id, symbol, side, placed_at, rule, limit_price. A market order
    takes any print, a limit buy one at or under its limit, a sell at or over.
    Without a symbol, a time, a side or a limit (NULL or NaN) an order has no print.

    Orders and prints are put in one order of symbol and time over ranges of
    about equal size, cut into slices of `rows`, however many fall in a moment.
    A task settles what finds its print in its slice. For the rest the least and
    highest prices of slices tell the slice in the same range, those of ranges
    the range and then its slice, and there only distinct limits are settled. So
    no pair of an order and a print is made, and no row comes to the driver.
    """
    spark = orders.sparkSession
    limit = F.nanvl(F.col("limit_price").cast("double"), F.lit(None).cast("double"))
    kind = F.when(F.col("rule") == "market", 0).when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1)
    kinds = dict(prints.select("printed_at", "print_id", "price").dtypes) | dict(orders.select("order_id").dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    p = prints.where("symbol is not null and printed_at is not null").select("symbol", "printed_at", "print_id", "price", null("order_id"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("double").alias("limit"))
    o = orders.select("symbol", F.col("placed_at").cast(kinds["printed_at"]).alias("printed_at"), null("print_id"), null("price"), "order_id", kind.alias("kind"), F.when(kind == 0, 0.0).otherwise(limit).alias("limit"))
    o = o.where("symbol is not null and printed_at is not null and kind is not null and limit is not null")
    # An order comes after the prints of its own moment.
    order = ["symbol", "printed_at", F.col("kind").isNotNull(), "print_id", "price", "order_id", "kind", "limit"]
    ranged = p.unionByName(o).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def settle(batches):
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cut, number = batch.slice(at, rows), number + 1
                asks = pc.is_valid(cut["kind"]).to_numpy(zero_copy_only=False)
                asked, printed = np.flatnonzero(asks), np.flatnonzero(~asks)
                names = cut["symbol"].dictionary_encode().indices.to_numpy()
                price = cut["price"].cast(pa.float64()).to_numpy(zero_copy_only=False)[printed]
                side, bound = (cut[c].to_numpy(zero_copy_only=False)[asked] for c in ("kind", "limit"))
                found = _fill_side((np.where(np.isnan(price), np.inf, price), np.where(np.isnan(price), -np.inf, price)), np.searchsorted(printed, asked), side, bound)
                hit = np.zeros(cut.num_rows, np.int64)
                hit[asked] = np.append(printed, 0)[found]
                none = np.ones(cut.num_rows, bool)
                none[asked] = (found >= len(printed)) | (names[hit[asked]] != names[asked])  # the first suitable print may be another symbol's
                take = pa.array(hit, mask=none)
                own = {"slice": pa.array(np.full(cut.num_rows, number, np.int32)), "place": pa.array(np.arange(cut.num_rows, dtype=np.int32)), "filled": pa.array(~none), "hit_at": cut["printed_at"].take(take), "hit_price": cut["price"].take(take)}
                yield pa.RecordBatch.from_arrays([*cut.columns, *own.values()], [*cut.schema.names, *own])

    more = T.StructType.fromDDL(f"slice int, place int, filled boolean, hit_at {kinds['printed_at']}, hit_price {kinds['price']}")
    own = ranged.mapInArrow(settle, T.StructType([*ranged.schema.fields, *more.fields]))
    own = _stored(own, "fills")

    value = F.nanvl(F.col("price").cast("double"), F.lit(None).cast("double"))
    low, high = F.coalesce(value, F.lit(float("inf"))), F.coalesce(value, F.lit(float("-inf")))
    there = own.where("kind is null").withColumn("low", low).withColumn("high", high)
    span = F.min("low").alias("low"), F.max("high").alias("high")
    slices = there.groupBy("symbol", "range", "slice").agg(*span).withColumnRenamed("slice", "place")
    ranges = slices.groupBy("symbol", F.col("range").alias("place")).agg(*span)
    wish = ["kind", "limit"]
    left = own.where("kind is not null and not filled").select("symbol", "range", "slice", "order_id", *wish)

    near = _stored(_seek(left.drop("order_id").distinct(), slices, ["symbol", "range"], "slice"), "near")
    # A group takes the open limits of 16 ranges; a range is a row or two.
    deals = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    far = near.where("place is null").select("symbol", "range", *wish).distinct().withColumn("deal", F.pmod("range", F.lit(deals)))
    dealt = ranges.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    far = _seek(far, dealt, ["symbol", "deal"], "range").where("place is not null").select("symbol", F.col("range").alias("from"), *wish, F.col("place").alias("range"), F.lit(-1).alias("slice"))
    far = _seek(far, slices, ["symbol", "range"], "slice").select("symbol", "from", *wish, F.col("range").alias("far_range"), F.col("place").alias("far_slice"))
    near = near.withColumnRenamed("place", "near_slice")
    goes = left.join(near, ["symbol", "range", "slice", *wish]).withColumnRenamed("range", "from").join(far, ["symbol", "from", *wish], "left")
    goes = goes.select("order_id", "symbol", *wish, F.when(F.col("near_slice").isNotNull(), F.col("from")).otherwise(F.col("far_range")).alias("range"), F.coalesce("near_slice", "far_slice").alias("slice")).where("slice is not null")
    goes = _stored(goes, "goes")
    keys = ["symbol", "range", "slice"]
    asked = goes.select(*keys, *wish, F.lit(-1).alias("before")).distinct()
    nodes = there.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "place", "low", "high", F.col("printed_at").alias("hit_at"), F.col("price").alias("hit_price"))
    carried = goes.join(_seek(asked, nodes, keys, "before"), [*keys, *wish])
    hits = ["order_id", F.col("hit_at").alias("printed_at"), F.col("hit_price").alias("price")]
    first = own.where("filled").select(*hits).unionByName(carried.select(*hits))
    return orders.join(first, "order_id", "left").withColumn("status", F.when(F.col("printed_at").isNull(), "UNFILLED").otherwise("FILLED"))


def auction_fills(orders: DataFrame, auctions: DataFrame) -> DataFrame:
    """Fills of orders for the closing auction (rule auction_close) and the opening one (auction_open) at the observed price.

    auctions: order_id, auction_price, observed_at, confirmed. A close fills only
    if it is known to be confirmed, an open only if it has formed (above 0). A
    confirmed close at or below 0, and an auction seen before the order was
    placed, fail the job.
    """
    j = orders.join(auctions, "order_id", "left")
    closing, price = F.col("rule") == "auction_close", F.col("auction_price")
    takes = F.when(closing, F.coalesce("confirmed", F.lit(False))).otherwise(F.coalesce(price > 0, F.lit(False)))
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.col("order_id")))
    paid = F.when(F.col("observed_at") < F.col("placed_at"), stop("an auction before its order: ")).when(closing & takes & ~F.coalesce(price > 0, F.lit(False)), stop("a confirmed close that isn't above 0: ")).when(takes, price)
    return j.withColumn("price", paid).withColumn("status", F.when(takes, "FILLED").otherwise("UNFILLED")).drop("auction_price")


def decision_returns(picks: DataFrame) -> DataFrame:
    """Entry at the close, exit at the next session's open: status and gross; rank by score."""
    status = F.when(F.col("next_date").isNull(), "PENDING").when(F.col("next_open").isNull(), "NO_EXIT").otherwise("REALIZED")
    return picks.withColumn("status", status).withColumn("gross", F.when(status == "REALIZED", F.col("next_open") / F.col("close") - 1))


def shadow_ledger(picks: DataFrame, gate_rows: int = 120) -> DataFrame:
    """Arms of a day that holds exactly three realized picks: equal three, best two, by score; and a trailing gate.

    The gate looks at the last `gate_rows` results that are there, strictly
    before the day; days without a result carry the gate on.
    """
    done = picks.where("status <> 'PENDING'")
    real = F.col("status") == "REALIZED"
    g = done.groupBy("date").agg(
        F.count("*").alias("n"),
        F.count_if(real).alias("n_real"),
        F.avg("net").alias("_k3"),
        F.avg(F.when(F.col("rank") <= 2, F.col("net"))).alias("_k2"),
        (F.sum(F.col("net") * F.greatest("pred", F.lit(0.0))) / F.nullif(F.sum(F.greatest("pred", F.lit(0.0))), F.lit(0.0))).alias("_sw"),
    )
    whole = (F.col("n") == 3) & (F.col("n_real") == 3)
    g = g.where("n = 3").select("date", *(F.when(whole, F.col(f"_{c}")).alias(c) for c in ("k3", "k2", "sw")))
    one = W.partitionBy(F.lit(1))
    known = g.where("k3 is not null").withColumn("gate_mean", F.avg("k3").over(one.orderBy("date").rowsBetween(-gate_rows, -1)))
    out = g.join(known.select("date", "gate_mean"), "date", "left")
    out = out.withColumn("gate_mean", F.coalesce("gate_mean", F.last("gate_mean", ignorenulls=True).over(one.orderBy("date").rowsBetween(W.unboundedPreceding, 0))))
    is_open = F.coalesce(F.col("gate_mean") > 0, F.lit(True))
    return out.withColumn("gate_open", is_open).withColumn("gated", F.when(is_open, F.col("k3")).otherwise(F.when(F.col("k3").isNotNull(), F.lit(0.0))))


def latest_status(log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last record of each key."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return log.groupBy(*keys).agg(last, F.count("*").alias("n_records")).select(*keys, "_v.*", "n_records")


def trailing_attempts(log: DataFrame, settled: Sequence[str] = ("DONE",)) -> DataFrame:
    """Distinct run days after the last settled record of a key; a run on the data's own day doesn't count.

    log: symbol, day, session, run_day, status, seq.
    """
    keys = ("symbol", "day", "session")
    end = F.max(F.when(F.col("status").isin(*settled), F.col("seq"))).over(W.partitionBy(*keys))
    open_ = log.withColumn("_end", end).where("seq > coalesce(_end, -1) and run_day <> day")
    return log.select(*keys).distinct().join(open_.groupBy(*keys).agg(F.count_distinct("run_day").alias("attempts")), list(keys), "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def coverage_report(planned: DataFrame, latest: DataFrame, keys: Sequence[str], settled: Sequence[str] = ("DONE",)) -> DataFrame:
    """By session: planned, resolved, and still open tasks."""
    j = planned.join(latest, list(keys), "left")
    done = F.coalesce(F.col("status").isin(*settled), F.lit(False))
    return j.groupBy("session").agg(F.count("*").alias("n_planned"), F.count_if(done).alias("n_resolved"), F.count_if(~done).alias("n_open"))


def task_plan(days: DataFrame, have: DataFrame, retention: int, as_of: str) -> DataFrame:
    """Symbol-days to fetch by vendor, with reasons for those that are skipped."""
    j = days.join(have.select("symbol", "day", F.lit(True).alias("have")), ["symbol", "day"], "left")
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    skip = F.when(F.col("have"), "stored").when(age > retention, "beyond_retention")
    return j.withColumn("skip", skip).withColumn("vendor", F.when(F.col("skip").isNull(), F.when(age <= retention / 2, "near").otherwise("far"))).select("symbol", "day", "vendor", "skip")


def streaks(audits: DataFrame) -> DataFrame:
    """Runs of consecutive audits in which a class was present. audits: class, seq."""
    w = W.partitionBy("class").orderBy("seq")
    island = audits.dropDuplicates(["class", "seq"]).withColumn("_i", F.col("seq") - F.row_number().over(w))
    runs = island.groupBy("class", "_i").agg(F.count("*").alias("length"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    return runs.drop("_i")


def job_lateness(due: DataFrame, runs: DataFrame, grace_minutes: int = 10) -> DataFrame:
    """Each due slot with the first run that began in time of the next slot: state.

    due: job, due_at; runs: job, began_at, outcome.
    """
    w = W.partitionBy("job").orderBy("due_at")
    slots = due.withColumn("until", F.coalesce(F.lead("due_at").over(w), F.col("due_at") + F.expr("INTERVAL 1 DAY")))
    j = slots.join(runs, "job", "left").where("began_at is null or (began_at >= due_at and began_at < until)")
    first = j.groupBy("job", "due_at").agg(F.min("began_at").alias("began_at"), F.min_by("outcome", "began_at").alias("outcome"))
    out = slots.select("job", "due_at").join(first, ["job", "due_at"], "left")
    late = F.col("began_at") > F.col("due_at") + F.expr(f"INTERVAL {grace_minutes} MINUTE")
    return out.withColumn("state", F.when(F.col("began_at").isNull(), "MISSING").when(late, "LATE").when(F.col("outcome") != "ok", "FAILED").otherwise("ON_TIME"))


def completeness_matrix(cal: DataFrame, artifacts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """A column for each artifact kind: whether the date has it."""
    wide = artifacts.groupBy("date").pivot("kind", list(kinds)).agg(F.count(F.lit(1)))
    out = cal.select("date").join(wide, "date", "left")
    return out.select("date", *((F.coalesce(F.col(k), F.lit(0)) > 0).alias(k) for k in kinds))


def manifest_reasons(entries: DataFrame) -> DataFrame:
    """Entries that aren't COMPLETE by reason."""
    return entries.where("status <> 'COMPLETE'").groupBy("status", "reason").agg(F.count("*").alias("n"))
