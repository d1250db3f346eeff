"""SQL pieces that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import market as M
from tapewright.plans import fixtures

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType | T.FloatType) else F.col(f"`{c.name}`") for c in df.schema))


def r(sql: str, digits: int = 6) -> str:
    return f"round(CAST({sql} AS DOUBLE), {digits})"


def _ladder(price: str, steps: tuple, top: int) -> str:
    return f"CASE WHEN NOT coalesce({price} > 0, false) THEN NULL " + " ".join(f"WHEN {price} < {b} THEN {float(t)}e0" for b, t in steps) + f" ELSE {float(top)}e0 END"


def tick(price: str, market: str, date: str) -> str:
    return (
        f"CASE WHEN {date} >= DATE '{M.TICK_REFORM}' THEN {_ladder(price, M.TICKS_FROM_2023, 1000)} WHEN {market} IN ('KOSDAQ','KSQ150') THEN {_ladder(price, M.TICKS_BEFORE_KOSDAQ, 100)} ELSE {_ladder(price, M.TICKS_BEFORE_KOSPI, 1000)} END"
    )


def text_draw_sql(text: str) -> str:
    return f"CAST('0x'||substr(md5({text}),1,8) AS BIGINT)"


def tick_bp(price: str, market: str, date: str) -> str:
    return f"CASE WHEN {price} > 0 THEN ({tick(price, market, date)}) / {price} * 1e4 END"


def tax(date: str) -> str:
    return "CASE " + " ".join(f"WHEN {date} >= DATE '{d}' THEN {bp}e0" for d, bp in reversed(M.TAX_BP)) + " END"


def change(close: str = "close", prev: str = "prev_close") -> str:
    return f"CASE WHEN {prev} > 0 AND abs({close}/{prev} - 1) <= 0.31e0 THEN {close}/{prev} - 1 END"


#: prep: the prepared panel (P1); cal: the sessions.
PREP = (
    fixtures.sql("price_history")
    + f""",
prep0 AS (SELECT *, {change()} AS chg_ratio, coalesce(trade_value_100m, close*volume/1e8) AS tv_clean,
  last_value(market_cap_100m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS mc_clean,
  {tick_bp("close_raw", "market", "date")} AS tick_cost_bp FROM price_history),
prep AS (SELECT *, coalesce(chg_ratio >= 0.29e0 AND close >= high, false) AS is_ceiling FROM prep0),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, lag(date) OVER (ORDER BY date) AS prev_date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM price_history))"""
)
BARS = fixtures.sql("bars_1m")
TICKS = fixtures.sql("ticks")
BARS_TICKS = fixtures.sql("bars_1m", "ticks")

#: Thresholds of the screen that fit the derived tables.
SCREEN = {"low": 0.01, "high": 0.29, "value": 0.05, "cap": 1000.0, "cost": 60.0}
SCREEN_SQL = "chg_ratio >= 0.01e0 AND chg_ratio < 0.29e0 AND tv_clean >= 0.05e0 AND mc_clean >= 1000e0 AND close_raw > 0 AND volume > 0 AND NOT is_ceiling"


def lit_date(text: str) -> Column:
    return F.lit(text).cast("date")
