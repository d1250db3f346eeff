"""Window helpers with the null rules that the panel operators rely on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_symbol() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("date")


def trailing(value: Column, rows: int, how: Callable[[Column], Column], least: int, lag: int = 1, over: WindowSpec | None = None) -> Column:
    """how(value) over the `rows` rows that end `lag` rows back; NULL with fewer than `least` values that aren't null."""
    frame = (over or by_symbol()).rowsBetween(-(rows + lag - 1), -lag)
    return F.when(F.count(value).over(frame) >= least, how(value).over(frame))


def with_extremes(rows: DataFrame, wanted: Mapping[str, tuple[str, Callable[..., Column]]], length: int, least: int) -> DataFrame:
    """rows with a column name -> (column, F.greatest or F.least) over the `length` rows up to and with the current one; NULL with fewer than `least` values.

    Extremes of twice as many rows come from two extremes of half as many, so a
    row costs steps by the logarithm of `length`, not `length` of them; counts are
    differences of running counts. All windows have one order: rows are sorted once.
    """
    w = by_symbol()
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        rows = rows.withColumn(f"_n_{column}", F.count(column).over(w.rowsBetween(W.unboundedPreceding, 0)))
    for name, (column, _) in wanted.items():
        rows = rows.withColumn(name, F.col(column))
    covered = 1
    while covered < length:
        step = min(covered, length - covered)
        rows = rows.withColumns({name: pick(F.col(name), F.lag(name, step).over(w)) for name, (_, pick) in wanted.items()})
        covered += step
    enough = {c: F.col(f"_n_{c}") - F.coalesce(F.lag(f"_n_{c}", length).over(w), F.lit(0)) >= least for c, _ in wanted.values()}
    return rows.withColumns({name: F.when(enough[c], F.col(name)) for name, (c, _) in wanted.items()}).drop(*(f"_n_{c}" for c in enough))


def forward_fill(value: Column, over: WindowSpec | None = None) -> Column:
    """The last value that isn't null, up to the row itself."""
    return F.last(value, ignorenulls=True).over((over or by_symbol()).rowsBetween(W.unboundedPreceding, 0))


def strictly_before(value: Column, over: WindowSpec | None = None) -> Column:
    """The last value that isn't null in earlier rows only."""
    return F.last(value, ignorenulls=True).over((over or by_symbol()).rowsBetween(W.unboundedPreceding, -1))


def pct_rank_avg(value: Column, keys: Sequence[str] = ("date",)) -> Column:
    """Average rank among the values that aren't null, over their count; NULL for NULL."""
    present = value.isNotNull()
    low = F.rank().over(W.partitionBy(*keys, present).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return F.when(present, (low + (ties - 1) / 2) / F.count(value).over(W.partitionBy(*keys)))


def product_after(value: Column, over: WindowSpec | None = None) -> Column:
    """Product of the values in later rows; 1 after the last one."""
    return F.coalesce(F.product(value).over((over or by_symbol()).rowsBetween(1, W.unboundedFollowing)), F.lit(1.0))


def clip(value: Column, low: float, high: float) -> Column:
    """Between low and high; a NULL stays NULL (least and greatest alone would drop it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def clean(value: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def text_draw(*parts: Column) -> Column:
    """A number below 2^32 by the MD5 of the parts as text, which other engines compute alike."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, day: str, order: str, name: str) -> DataFrame:
    """rows numbered from 0 by day and order: inside each day, plus the rows of the days before. Only the days meet in one task."""
    per_day = rows.groupBy(day).agg(F.count("*").alias("_k"))
    before = per_day.select(F.col(day).alias("_day"), F.coalesce(F.sum("_k").over(W.partitionBy(F.lit(1)).orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(day).orderBy(order)) - 1
    return rows.withColumn("_in", inside).join(before, F.col(day) == F.col("_day")).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", "_day")
