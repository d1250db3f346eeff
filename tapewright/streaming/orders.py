"""T5: the state of order intents in a stream.

An intent's events are applied in the order of their sequence, whatever order
and batch they come in: one that comes early waits until those before it are
there. A sequence that comes twice, a second intent record and fills that can't
be mark the intent as corrupt, for good.

The store keeps an intent's events, five numbers each, with the time of the
batch that each came in, so that the fold gives what a fold batch by batch
gives. All of it is built-in functions: no row goes to Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Evidence of each number of a code; what is of no other kind is 0.
_INTENT, _SEND, _ACK, _REJECTED, _NOT_SENT, _RESULT, _NOT_FOUND, _SKIP, _FINAL, _CANCELLED, _BROKER = range(1, 12)
_KNOWN = "struct<bits:long,n_sends:long,send:long,result:long,not_found:long,qty:long,filled:long,at:long,wrong:string,wrong_at:long>"


def _code() -> Column:
    """kind and outcome as a number."""
    kind, outcome = F.col("kind"), F.col("outcome")
    of_result = F.when(outcome.isin("accepted", "adopted"), _ACK).when(outcome == "rejected", _REJECTED).when(outcome.isin("throttled", "auth_rejected", "not_sent"), _NOT_SENT).otherwise(_RESULT)
    of_broker = F.when(outcome == "final", _FINAL).when(outcome == "cancelled", _CANCELLED).otherwise(_BROKER)
    code = F.when(kind == "INTENT", _INTENT).when(kind == "SEND", _SEND).when(kind == "RESULT", of_result).when((kind == "LOOKUP") & (outcome == "not_found"), _NOT_FOUND).when(kind == "SKIP", _SKIP).when(kind == "BROKER_STATE", of_broker)
    return F.coalesce(code, F.lit(0)).cast("byte")


def _applied(known: Column, event: Column) -> Column:
    """What is known once an event is added; `wrong` is the first thing that can't be, `wrong_at` the batch that the event could be applied in."""
    code, qty = event["code"], F.greatest(known["qty"], event["qty"])  # greatest skips NULL
    last = lambda name, *codes: F.when(code.isin(*codes), event["seq"]).otherwise(known[name]).alias(name)
    at, filled = F.greatest(known["at"], event["at"]), F.when(code.isin(_FINAL, _CANCELLED, _BROKER), event["filled"])
    bad_fill = F.when(filled < 0, "negative fill").when(filled > qty, "fill beyond the quantity").when(filled < F.coalesce(known["filled"], F.lit(0)), "fill decreased")
    wrong = F.when((code == _INTENT) & (known["bits"].bitwiseAND(1 << _INTENT) != 0), "second intent record").otherwise(bad_fill)
    return F.struct(
        known["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), code.cast("int"))).alias("bits"),
        (known["n_sends"] + F.when(code == _SEND, 1).otherwise(0)).alias("n_sends"),
        last("send", _SEND),
        last("result", _ACK, _REJECTED, _NOT_SENT, _RESULT),
        last("not_found", _NOT_FOUND),
        qty.alias("qty"),
        F.coalesce(filled, known["filled"]).alias("filled"),
        at.alias("at"),
        F.coalesce(known["wrong"], wrong).alias("wrong"),
        F.coalesce(known["wrong_at"], F.when(wrong.isNotNull(), at)).alias("wrong_at"),
    )


def _status() -> Column:
    """The highest evidence decides, as in the batch fold."""
    known = F.col("known")
    seen = lambda *codes: known["bits"].bitwiseAND(sum(1 << c for c in codes)) != 0
    filled = F.coalesce(known["filled"], F.lit(0))
    of_final = F.when(filled >= known["qty"], "FILLED").when(filled > 0, "PARTIAL").when(seen(_CANCELLED), "CANCELLED").otherwise("UNFILLED")
    return (
        F.when(F.col("reason").isNotNull(), "CORRUPT")
        .when(seen(_FINAL, _CANCELLED), of_final)
        .when(seen(_ACK), "ACKED")
        .when(seen(_REJECTED), "REJECTED")
        .when(known["not_found"] > F.coalesce(known["send"], F.lit(-1)), "NOT_FOUND")
        .when(known["send"].isNotNull() & (known["result"].isNull() | (known["result"] < known["send"])), "UNKNOWN")
        .when(seen(_NOT_SENT), "NOT_SENT")
        .when(seen(_SKIP), "SKIPPED")
        .otherwise("RECORDED")
    )


def order_states(events: DataFrame, first_seq: int = 0) -> DataFrame:
    """intent_id, status, filled, n_sends, reason, missing_seq: a row for each intent that a batch touches, from the events whose predecessors are all there.

    events: intent_id, seq, kind, outcome, qty, filled. status is CORRUPT, with
    the reason, once a sequence comes twice, a second INTENT comes, or a fill
    is negative, beyond the quantity or less than one before. missing_seq is
    the sequence that later ones wait for. Rows without intent or sequence stop
    the query. Of a sequence that comes twice the first is applied. Start the
    stream inside `rocks_store`.
    """
    whole = events.selectExpr("assert_true(intent_id is not null and seq is not null, 'an event without intent or sequence') is null as _ok", "cast(intent_id as long) intent_id", "cast(seq as long) seq", "kind", "outcome", "cast(qty as long) qty", "cast(filled as long) filled").where("_ok")
    at = F.unix_millis(F.current_timestamp())  # in a stream the time of the batch, also when it runs again
    held = whole.select("intent_id", F.struct("seq", at.alias("at"), _code().alias("code"), "qty", "filled").alias("x")).groupBy("intent_id").agg(F.sort_array(F.collect_list("x")).alias("e"))
    first = lambda x, i: (x["seq"] >= first_seq) & ((i == 0) | (F.get("e", i - 1)["seq"] != x["seq"]))
    split = held.withColumns({"once": F.filter("e", first), "again_at": F.array_min(F.transform(F.filter("e", lambda x, i: ~first(x, i)), lambda x: x["at"]))})
    ready = split.withColumn("ready", F.filter("once", lambda x, i: x["seq"] == i + F.lit(first_seq).cast("long")))
    nothing = F.lit(None)
    start = F.struct(F.lit(0), F.lit(0), *[nothing] * 8).cast(_KNOWN)
    known = ready.withColumn("known", F.aggregate("ready", start, lambda a, x: _applied(a, x).cast(_KNOWN)))
    repeated = F.col("again_at").isNotNull() & (F.col("known.wrong_at").isNull() | (F.col("again_at") <= F.col("known.wrong_at")))
    told = known.withColumn("reason", F.when(repeated, "repeated sequence").otherwise(F.col("known.wrong")))
    missing = F.when(F.size("once") > F.size("ready"), F.size("ready") + F.lit(first_seq).cast("long"))
    return told.select("intent_id", _status().alias("status"), F.coalesce("known.filled", F.lit(0)).cast("long").alias("filled"), F.col("known.n_sends").alias("n_sends"), "reason", missing.alias("missing_seq"))


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the heap."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
