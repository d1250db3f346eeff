"""Rules of the market as column expressions: ticks, tax, costs, returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price bounds below which each tick holds, and the tick above all of them.
TICKS_FROM_2023 = ((2000, 1), (5000, 5), (20000, 10), (50000, 50), (200000, 100), (500000, 500))
TICKS_BEFORE_KOSPI = ((1000, 1), (5000, 5), (10000, 10), (50000, 50), (100000, 100), (500000, 500))
TICKS_BEFORE_KOSDAQ = ((1000, 1), (5000, 5), (10000, 10), (50000, 50))
TICK_REFORM = "2023-01-25"
KOSDAQ_LABELS = ("KOSDAQ", "KSQ150")
# Sell tax in bp from a date on.
TAX_BP = (("1996-01-01", 30.0), ("2019-06-03", 25.0), ("2021-01-01", 23.0), ("2023-01-01", 20.0), ("2024-01-01", 18.0), ("2025-01-01", 15.0), ("2026-01-01", 20.0))
# Fixed value: broker fee of a round trip in bp.
FEE_BP = 0.72792
CHANGE_LIMIT, CEILING, HAIRCUT = 0.31, 0.29, 0.5


def _ladder(price: Column, steps: tuple, top: int) -> Column:
    out = F.lit(float(top))
    for bound, tick in reversed(steps):
        out = F.when(price < bound, F.lit(float(tick))).otherwise(out)
    return F.when(price > 0, out)


def tick_size(price: Column, market: Column, date: Column) -> Column:
    before = F.when(market.isin(*KOSDAQ_LABELS), _ladder(price, TICKS_BEFORE_KOSDAQ, 100)).otherwise(_ladder(price, TICKS_BEFORE_KOSPI, 1000))
    return F.when(date >= F.lit(TICK_REFORM).cast("date"), _ladder(price, TICKS_FROM_2023, 1000)).otherwise(before)


def tick_cost_bp(price: Column, market: Column, date: Column) -> Column:
    return F.when(price > 0, tick_size(price, market, date) / price * 1e4)


def tax_bp(date: Column) -> Column:
    out = F.lit(None).cast("double")
    for since, bp in TAX_BP:
        out = F.when(date >= F.lit(since).cast("date"), F.lit(bp)).otherwise(out)
    return out


def round_trip_bp(price: Column, market: Column, date: Column, ticks: float = 2.0) -> Column:
    return tax_bp(date) + ticks * tick_cost_bp(price, market, date) + FEE_BP


def net_return(gross: Column, cost_bp: Column) -> Column:
    return gross - cost_bp / 1e4


def change_ratio(close: Column, prev: Column) -> Column:
    """close / prev - 1; NULL without a positive previous close or beyond the daily limit."""
    ratio = close / prev - 1
    return F.when((prev > 0) & (F.abs(ratio) <= CHANGE_LIMIT), ratio)


def is_mixed_unit(stored: Column, ratio: Column, rtol: float = 1e-4) -> Column:
    """A stored change that is the ratio in per cent and not the ratio."""
    near = lambda a, b: F.abs(a - b) <= rtol * F.abs(b)
    return F.coalesce(near(stored, ratio * 100) & ~near(stored, ratio), F.lit(False))


def is_ceiling(change: Column, close: Column, high: Column) -> Column:
    return F.coalesce((change >= CEILING) & (close >= high), F.lit(False))
