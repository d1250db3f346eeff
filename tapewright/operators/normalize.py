"""Vendor payloads to canonical rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BAR_COLUMNS = ("snapshot_date", "symbol", "ts_hms", "open", "high", "low", "close", "volume", "value_krw", "has_trade", "vendor")


def cumulative_to_value(bars: DataFrame, cumulative: str = "cum_value") -> DataFrame:
    """The difference of the cumulative value; clamped at 0; used if it fits the bar, else close * volume."""
    w = W.partitionBy("snapshot_date", "symbol").orderBy("ts_hms")
    step = F.greatest(F.col(cumulative) - F.coalesce(F.lag(cumulative).over(w), F.lit(0)), F.lit(0))
    fits = F.when(F.col("volume") == 0, step == 0).otherwise(step.between(F.col("low") * F.col("volume"), F.col("high") * F.col("volume")))
    return bars.withColumn("from_cumulative", fits).withColumn("value_krw", F.when(fits, step).otherwise(F.col("close") * F.col("volume")).cast("double"))


def _bars(time: str, prices: tuple[str, str, str, str], volume: str, value: str | None = None, sign: bool = False) -> dict[str, str]:
    number = lambda c: f"abs(try_cast({c} AS DOUBLE))" if sign else f"try_cast({c} AS DOUBLE)"
    out = {"ts_hms": f"try_cast({time} AS INT)", **dict(zip(("open", "high", "low", "close"), map(number, prices), strict=True)), "volume": f"CAST({number(volume)} AS BIGINT)"}
    return out | {"value_krw": value or f"{out['close']} * {number(volume)}"}


#: For each vendor the expressions of the canonical columns over its own text columns; text that is no number is NULL. The field names are fixed.
VENDOR_BARS: Mapping[str, Mapping[str, str]] = {
    "ls": _bars("time", ("open", "high", "low", "close"), "jdiff_vol", "try_cast(value AS DOUBLE) * 1000000"),
    "kiwoom": _bars("right(cntr_tm, 6)", ("open_pric", "high_pric", "low_pric", "cur_prc"), "trde_qty", sign=True),
    "toss": _bars("replace(substring_index(substring_index(timestamp, 'T', -1), '.', 1), ':', '')", ("openPrice", "highPrice", "lowPrice", "closePrice"), "volume"),
    "dbsec": _bars("Hour", ("Oprc", "Hprc", "Lprc", "Prpr"), "CntgVol"),
}


def vendor_bars(raw: DataFrame, vendor: str) -> DataFrame:
    """Canonical columns; an unknown vendor raises, as does a missing field."""
    if vendor not in VENDOR_BARS:
        raise ValueError(f"unknown vendor {vendor}")
    m = VENDOR_BARS[vendor]
    out = raw.select("snapshot_date", "symbol", *(F.expr(m[c]).alias(c) for c in ("ts_hms", "open", "high", "low", "close", "volume", "value_krw")))
    return canonical_bars(out, vendor)


def canonical_bars(bars: DataFrame, vendor: str) -> DataFrame:
    """The canonical types, columns and order; `has_trade` is a volume above 0, false if that is unknown."""
    types = {"ts_hms": "int", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint", "value_krw": "double"}
    cast = [F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in types.items()]
    out = bars.select("snapshot_date", F.lpad(F.col("symbol").cast("string"), 6, "0").alias("symbol"), *cast)
    return out.withColumn("has_trade", F.coalesce(F.col("volume") > 0, F.lit(False))).withColumn("vendor", F.lit(vendor)).select(*BAR_COLUMNS)


def normalize_ticks(raw: DataFrame, limit: int) -> DataFrame:
    """Canonical ticks; optional columns that are absent are NULL; `truncated` where a symbol's day reached the page limit."""
    opt = [F.expr(f"try_cast({c} AS {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in (("trade_strength", "float"), ("ask1", "int"), ("bid1", "int"))]
    n = F.count("*").over(W.partitionBy("snapshot_date", "symbol"))
    return raw.select("snapshot_date", "symbol", *(F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in (("ts_hms", "int"), ("price", "int"), ("volume", "bigint"))), *opt, (n >= limit).alias("truncated"), "vendor")


def business_date(rows: DataFrame, column: str, requested: str) -> DataFrame:
    """N5"""
    return rows.where(F.col(column) == requested)


def exchange_block(raw: DataFrame) -> DataFrame:
    """Numbers with commas, base = close - change, money to 100M units; codes that repeat are marked."""
    num = lambda c: F.expr(f"try_cast(replace({c}, ',', '') AS DOUBLE)")
    out = raw.select(
        F.to_date("BAS_DD", "yyyyMMdd").alias("date"),
        F.lpad("ISU_CD", 6, "0").alias("symbol"),
        F.col("MKT_NM").alias("market"),
        num("TDD_OPNPRC").alias("open"),
        num("TDD_HGPRC").alias("high"),
        num("TDD_LWPRC").alias("low"),
        num("TDD_CLSPRC").alias("close"),
        (num("TDD_CLSPRC") - num("CMPPREVDD_PRC")).alias("base_price"),
        num("ACC_TRDVOL").alias("volume"),
        (num("ACC_TRDVAL") / 1e8).alias("trade_value_100m"),
        (num("MKTCAP") / 1e8).alias("market_cap_100m"),
    )
    return out.withColumn("repeated", F.count("*").over(W.partitionBy("date", "symbol")) > 1)


def flow_rows(payloads: DataFrame) -> DataFrame:
    """JSON arrays of {d, s, i, f, p} to rows in millions."""
    rows = payloads.select(F.explode(F.from_json("payload", "array<struct<d:string,s:string,i:double,f:double,p:double>>")).alias("r"))
    return rows.select(F.to_date("r.d").alias("date"), F.lpad("r.s", 6, "0").alias("symbol"), *((F.col(f"r.{k}") / 1e6).alias(n) for k, n in (("i", "inst_netbuy"), ("f", "foreign_netbuy"), ("p", "program_netbuy"))))


def join_flows(panel: DataFrame, flows: DataFrame) -> DataFrame:
    """What is missing stays NULL."""
    return panel.join(flows, ["date", "symbol"], "left")


def alt_panel(raw: DataFrame, universe: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with whole keys and known names; the newest of each key."""
    ok = raw.where(" and ".join(f"{k} is not null" for k in keys)).join(universe.select("symbol").distinct(), "symbol", "left_semi")
    w = W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def classification(raw: DataFrame) -> DataFrame:
    """Common stock on a main board without flags is screenable."""
    flagged = F.coalesce(F.col("halted"), F.lit(False)) | F.coalesce(F.col("administrative"), F.lit(False))
    return raw.select("date", F.lpad("code", 6, "0").alias("symbol"), ((F.col("kind") == "common") & F.col("board").isin("KOSPI", "KOSDAQ") & ~flagged).alias("is_screenable"), "kind", "board")


def earliest_of_pages(pages: DataFrame, schema: str) -> DataFrame:
    """Ranking pages (page, attempt, payload) to one row a symbol, the earliest."""
    rows = pages.select("page", "attempt", F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r"))
    return rows.groupBy(F.col("r.symbol").alias("symbol")).agg(F.min_by("r", F.struct("page", "attempt")).alias("r"), F.min(F.struct("page", "attempt")).alias("at")).select("symbol", F.col("r.value").alias("value"), "at.page", "at.attempt")


def last_attempt(quotes: DataFrame, values: Sequence[str]) -> DataFrame:
    """The last attempt of a symbol wins."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*values), F.struct("attempt", "seq")).alias("v"), F.max("attempt").alias("attempt")).select("symbol", "attempt", "v.*")


def nested_series(payloads: DataFrame) -> DataFrame:
    """Arrays of {h, v} of the last attempt to a row for each (symbol, hour)."""
    last = payloads.groupBy("symbol").agg(F.max_by("payload", "attempt").alias("payload"))
    rows = last.select("symbol", F.explode(F.from_json("payload", "array<struct<h:int,v:double>>")).alias("r"))
    return rows.groupBy("symbol", F.col("r.h").alias("hour")).agg(F.max("r.v").alias("value"))


def assemble_extras(cohort: DataFrame, scan: DataFrame, quotes: DataFrame) -> DataFrame:
    """N14"""
    return cohort.join(scan, "symbol", "left").join(quotes, "symbol", "left")


def auction_path(prints: DataFrame, start: int = 152000, fill_at: int = 153000) -> DataFrame:
    """Prints of the closing auction, the newest last, by class, with their place."""
    rows = prints.where(F.col("ts_hms") >= start)
    kind = F.when(F.col("ts_hms") >= fill_at, "AUCTION_FILL").when(F.col("volume") > 0, "UNEXPECTED_TRADE").otherwise("INDICATIVE")
    return rows.withColumn("kind", kind).withColumn("seq", F.row_number().over(W.partitionBy("snapshot_date", "symbol").orderBy("ts_hms", "event_id")).cast("long"))


def strength_as_of(rows: DataFrame, cutoff: int = 152000) -> DataFrame:
    """The value at the highest cumulative volume, before the cutoff and overall."""
    at = F.struct("cum_volume", "ts_hms")
    return rows.groupBy("snapshot_date", "symbol").agg(F.max_by("strength", F.when(F.col("ts_hms") < cutoff, at)).alias("strength_1520"), F.max_by("strength", at).alias("strength_eod"))


def category_counts(docs: DataFrame, categories: Mapping[str, str], material: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows by keyword pattern, and whether any material category occurs."""
    hit = {n: F.coalesce(F.col("title").rlike(p), F.lit(False)) for n, p in categories.items()}
    any_material = F.lit(False)
    for n in material:
        any_material = any_material | hit[n]
    return docs.groupBy(*keys).agg(*(F.count_if(c).alias(f"n_{n}") for n, c in hit.items()), F.bool_or(any_material).alias("material"))


def front_month(contracts: DataFrame, product: str) -> DataFrame:
    """Of a date the nearest expiry not before its month, else the least; spreads are out. name: '<product> F 202406'."""
    ym = F.regexp_extract("name", r"F (\d{6})$", 1)
    rows = contracts.where((F.col("product") == product) & ~F.col("name").contains("SP") & (ym != "")).withColumn("expiry", ym.cast("int"))
    past = F.col("expiry") < F.date_format("date", "yyyyMM").cast("int")
    w = W.partitionBy("date").orderBy(past, "expiry")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("basis", F.col("settle") - F.col("spot"))


def candidate_union(lists: Sequence[DataFrame]) -> DataFrame:
    """Vendor rankings with source and place; each symbol once, from the first list that has it."""
    both = lists[0].withColumn("turn", F.lit(0))
    for k, other in enumerate(lists[1:], 1):
        both = both.unionByName(other.withColumn("turn", F.lit(k)))
    return both.groupBy("date", "symbol").agg(F.min(F.struct("turn", "place")).alias("a"), F.count("*").alias("n_lists")).select("date", "symbol", "a.turn", "a.place", "n_lists")


def roster_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows with reasons): the first occurrence of a symbol decides."""
    first = F.row_number().over(W.partitionBy("symbol").orderBy("place"))
    reason = F.when(~F.coalesce(F.col("symbol").rlike("^[0-9]{6}$"), F.lit(False)), "bad_code").when(first > 1, "repeated").when(F.col("name").isNull(), "no_name")
    judged = raw.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


SNAPSHOT_NAMES = {"종목코드": "symbol", "시가": "open", "고가": "high", "저가": "low", "종가": "close", "전일종가": "prev_close", "거래량": "volume", "거래대금": "trade_value", "등락률": "chg_pct"}


def snapshot_to_panel(snapshot: DataFrame) -> DataFrame:
    """Known columns renamed, per cent to ratio, money to 100M units; others pass."""
    out = snapshot.withColumnsRenamed(SNAPSHOT_NAMES).withColumn("symbol", F.lpad("symbol", 6, "0"))
    return out.withColumn("chg_ratio", F.col("chg_pct") / 100).withColumn("trade_value_100m", F.col("trade_value") / 1e8).drop("chg_pct", "trade_value")


def panel_to_snapshot(panel: DataFrame) -> DataFrame:
    out = panel.withColumn("chg_pct", F.col("chg_ratio") * 100).withColumn("trade_value", F.col("trade_value_100m") * 1e8).drop("chg_ratio", "trade_value_100m")
    return out.withColumnsRenamed({v: k for k, v in SNAPSHOT_NAMES.items()})


def clean_journal(raw: DataFrame, names: Mapping[str, str], numbers: Sequence[str]) -> DataFrame:
    """Renamed columns; numbers without signs of per cent, commas and blanks."""
    out = raw.withColumnsRenamed(dict(names))
    for c in numbers:
        out = out.withColumn(c, F.expr(f"try_cast(regexp_replace(`{c}`, '[,%\\\\s]', '') AS DOUBLE)"))
    return out


SECRET_PATTERNS = ((r"(?i)\b(app_?key|api_?key|secret|token|password|passwd)\b(\s*[=:]\s*)([^\s,;&\"']+)", "$1$2***"), (r"(?i)\b(bearer\s+)[a-z0-9._~+/=-]{8,}", "$1***"))


def mask_secrets(text: Column) -> Column:
    """Values of credential-shaped pairs and bearer tokens."""
    for pattern, by in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, by)
    return text
