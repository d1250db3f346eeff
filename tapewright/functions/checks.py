"""Contracts that stop a job instead of passing bad rows on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input that an operator must not work on."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df; raises if a key repeats. One aggregation by key, of which three offenders are shown."""
    if again := df.groupBy(*keys).count().where("count > 1").limit(3).collect():
        raise ContractError(f"repeated keys {tuple(keys)}: {[tuple(r[k] for k in keys) for r in again]}")
    return df


def stop_where(df: DataFrame, bad: Column, what: str, show: Sequence[str], column: str) -> DataFrame:
    """df; a bad row stops the job that reads `column`, with no job of its own."""
    seen = F.concat_ws(" ", F.lit(f"{what}:"), *(F.col(c).cast("string") for c in show))
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(seen)).otherwise(F.col(column)))


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; NULL if none does. Every excluded row has a reason."""
    out = F.lit(None).cast("string")
    for name, when in reversed(reasons):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def split_by_reason(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go with `reason`)."""
    judged = df.withColumn("reason", first_reason(reasons))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
