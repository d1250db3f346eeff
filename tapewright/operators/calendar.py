"""Sessions, as-of joins and bitemporal reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions.checks import ContractError, first_reason


def sessions(panel: DataFrame) -> DataFrame:
    """Date, pos, prev_date, next_date; one row for each session, so the window is small."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    days = panel.select("date").distinct()
    return days.select("date", F.row_number().over(w).alias("pos"), F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))


def previous_session(days: DataFrame, cal: DataFrame, within: int = 10) -> DataFrame:
    """The last session before each day, at most `within` calendar days back."""
    asked = days.select(F.col("date").alias("asked")).distinct()
    j = asked.join(F.broadcast(cal.select("date")), (F.col("date") < F.col("asked")) & (F.col("date") >= F.date_sub("asked", within)), "left")
    return j.groupBy("asked").agg(F.max("date").alias("prev_session"))


def assert_fresh(panel: DataFrame, expected: str) -> DataFrame:
    """The history must reach the expected session."""
    last = panel.agg(F.max("date").alias("d")).first().d
    if last is None or str(last) < expected:
        raise ContractError(f"history ends {last}, expected {expected}")
    return panel


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], key: str = "symbol", on: str = "date", inclusive: bool = False) -> DataFrame:
    """The right side's last row before (or at) the left row's date, as one union and one window.

    Costs one shuffle by key, whatever the distance between dates.
    `<value>_asof` and `asof_date` are added.
    """
    names = [f"{v}_asof" for v in values]
    r = right.select(key, on, F.struct(*(F.col(v).alias(n) for v, n in zip(values, names, strict=True)), F.col(on).alias("asof_date")).alias("_row"), F.lit(0 if inclusive else 1).alias("_turn"))
    l_ = left.withColumn("_is_left", F.lit(True)).withColumn("_turn", F.lit(1 if inclusive else 0))
    both = l_.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(on, "_turn").rowsBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.last("_row", ignorenulls=True).over(w)).where("_is_left")
    return seen.select(*left.columns, *(F.col(f"_seen.{n}").alias(n) for n in (*names, "asof_date")))


def next_session_join(rows: DataFrame, panel: DataFrame, cal: DataFrame, values: Sequence[str]) -> DataFrame:
    """Values of the symbol on the calendar's next session, not on its own next row."""
    dated = rows.join(F.broadcast(cal.select("date", "next_date")), "date", "left")
    right = panel.select(F.col("date").alias("next_date"), "symbol", *(F.col(v).alias(f"next_{v}") for v in values))
    return dated.join(right, ["next_date", "symbol"], "left")


def next_row(panel: DataFrame) -> DataFrame:
    """Date and prices of the symbol's following row."""
    w = W.partitionBy("symbol").orderBy("date")
    return panel.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("date", "open", "high", "low", "close")))


def lagged_index(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The median of each column by date, one session later."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    daily = panel.groupBy("date").agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in columns))
    return daily.select("date", *(F.lag(c).over(w).alias(f"{c}_lag1") for c in columns))


def latest_by_symbol(panel: DataFrame, values: Sequence[str]) -> DataFrame:
    """C9"""
    return panel.groupBy("symbol").agg(F.max("date").alias("date"), *(F.max_by(v, "date").alias(v) for v in values))


def live_stitch(panel: DataFrame, today: DataFrame, day: str) -> DataFrame:
    """Rows strictly before the day and the day's own."""
    return panel.where(F.col("date") < F.lit(day).cast("date")).unionByName(today, allowMissingColumns=True)


def class_verdict(rows: DataFrame, classes: DataFrame, cal: DataFrame) -> DataFrame:
    """C11: is_screenable as of the previous session; before the classes begin, a proxy by code.

    A symbol that is absent from a covered session is not screenable; a session
    missing inside the coverage raises.
    """
    span = classes.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    covered = cal.join(F.broadcast(span), F.col("date").between(F.col("lo"), F.col("hi"))).select("date")
    if gap := covered.join(classes.select("date").distinct(), "date", "left_anti").limit(1).collect():
        raise ContractError(f"classes have no rows for {gap[0].date}")
    past = rows.join(F.broadcast(cal.select("date", "prev_date")), "date", "left").crossJoin(F.broadcast(span))
    known = classes.select(F.col("date").alias("prev_date"), "symbol", F.col("is_screenable").alias("_real"))
    j = past.join(known, ["prev_date", "symbol"], "left")
    proxy = F.substring("symbol", -1, 1) == "0"
    in_cover = F.coalesce(F.col("prev_date") >= F.col("lo"), F.lit(False))
    verdict = F.when(in_cover, F.coalesce("_real", F.lit(False))).otherwise(proxy)
    return j.withColumn("is_screenable", verdict).withColumn("source", F.when(in_cover, "classified").otherwise("proxy")).drop("prev_date", "lo", "hi", "_real")


def proxy_agreement(classes: DataFrame) -> DataFrame:
    """The proxy against the real verdict, in all and by verdict."""
    proxy = F.substring("symbol", -1, 1) == "0"
    marked = classes.select("is_screenable", proxy.alias("proxy"))
    out = marked.groupingSets([["is_screenable"], []], "is_screenable").agg(F.count("*").alias("n"), F.count_if(F.col("proxy") == F.col("is_screenable")).alias("n_agree"), F.count_if(F.col("proxy") & ~F.col("is_screenable")).alias("n_false_pass"), F.count_if(~F.col("proxy") & F.col("is_screenable")).alias("n_false_drop"))
    return out.withColumn("scope", F.coalesce(F.col("is_screenable").cast("string"), F.lit("all"))).drop("is_screenable")


def class_gaps(classes: DataFrame, cal: DataFrame) -> DataFrame:
    """Sessions inside the coverage without classes."""
    span = classes.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return cal.join(F.broadcast(span), F.col("date").between(F.col("lo"), F.col("hi"))).select("date").join(classes.select("date").distinct(), "date", "left_anti")


def read_as_of(runs: DataFrame, cutoff: str, keys: Sequence[str], statuses: Sequence[str] = ("COMPLETE", "PARTIAL")) -> DataFrame:
    """C14: of each key the newest run that had ended by the cutoff with a good status."""
    good = runs.where(F.col("status").isin(*statuses) & (F.col("completed_at") <= F.lit(cutoff).cast("timestamp")))
    return good.groupBy(*keys).agg(F.max(F.struct("completed_at", "run_id")).alias("_r")).select(*keys, F.col("_r.completed_at").alias("completed_at"), F.col("_r.run_id").alias("run_id"))


def session_kind(days: DataFrame, overrides: DataFrame, cal: DataFrame) -> DataFrame:
    """An override, else open if in the verified calendar, else by weekday."""
    last = cal.agg(F.max("date").alias("_last"))
    j = days.join(F.broadcast(overrides), "date", "left").join(F.broadcast(cal.select("date", F.lit(True).alias("_open"))), "date", "left").crossJoin(F.broadcast(last))
    kind = F.coalesce(F.col("kind"), F.when(F.col("_open"), "open"), F.when(F.col("date") <= F.col("_last"), "closed"), F.when(F.dayofweek("date").isin(1, 7), "closed").otherwise("open"))
    return j.select("date", kind.alias("kind"))


def offset_tasks(universe: DataFrame, cal: DataFrame) -> DataFrame:
    """(T, evening) and (T + 1, premarket) for every name of T, with the names as a sorted list."""
    j = universe.join(F.broadcast(cal.select("date", "next_date")), "date")
    rows = j.select("symbol", F.explode(F.array(F.struct(F.col("date").alias("day"), F.lit("evening").alias("session")), F.struct(F.col("next_date").alias("day"), F.lit("premarket").alias("session")))).alias("t"))
    return rows.where("t.day is not null").groupBy(F.col("t.day").alias("day"), F.col("t.session").alias("session")).agg(F.count_distinct("symbol").alias("n_symbols"), F.min("symbol").alias("first_symbol"))


def cohort_split(cohort: DataFrame, prices: DataFrame) -> DataFrame:
    """C17: members and rejected names of a cohort, with reasons."""
    j = cohort.join(prices.select("date", "symbol", "close", "volume"), ["date", "symbol"], "left")
    return j.withColumn("reason", first_reason([("no_price", F.col("close").isNull()), ("not_traded", F.col("volume") <= 0)])).withColumn("member", F.col("reason").isNull())
