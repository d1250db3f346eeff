"""Operator 7, line dedup, in DataFrame functions only.

Lines are exploded with their place and hashed; of hashes that two documents or
more hold the documents are counted; lines whose hash has too many go, by
place, from all documents but one; the others are put together in the order
they had. Lines themselves are never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import field, kept, whole_row

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
#: Keys in more than one HOT-th of all lines that can go; there are fewer than HOT of them.
HOT = 1000


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, least: int = 10, most: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and the new text.

    Keys of `least` code points or more that more than `most` documents hold
    lose all their lines except in the document with the least id; a null id
    comes before all others. Rows that repeat an id are one document here,
    whether their texts are equal or not. A text that loses all lines becomes
    empty; a null text becomes an empty line. Columns n_lines and n_dropped of
    docs are replaced; an empty table gives an empty one.

    A common line is no hot spot: documents are counted in part before rows are
    sent, and the few keys with more than a HOT-th of the lines are sent to all
    tasks, so that only rows of the other keys are shuffled by key.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(whole_row(docs, names).alias("row"), at.alias("at"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("body"))
    laid = own.select("at", "version", F.posexplode(_lines(F.col("body"))).alias("place", "line"))
    keyed = laid.select("at", "version", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    hashed = kept(keyed.select("at", "version", "place", F.xxhash64("key").alias("h"), F.hash("key").alias("g")), "lines")

    # Sums made in part before rows are sent; keys of one document never make a row again.
    several = hashed.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where("first < last")
    several = kept(several.select("h", "g", "first", "n"), "shared-lines")
    hot = (several.agg(F.sum("n")).first()[0] or 0) / HOT
    few, many = several.where(F.col("n") > hot).drop("n"), several.where(F.col("n") <= hot).drop("n")
    rare = hashed.join(F.broadcast(few.select("h", "g")), ["h", "g"], "left_anti")
    shared = hashed.join(F.broadcast(few), ["h", "g"]).unionByName(rare.join(many, ["h", "g"]))
    if most > 1:  # a key of two documents or more has more than one
        shared = kept(shared, "shared")
        counted = shared.groupBy("h", "g").agg(F.countDistinct("at").alias("documents")).where(F.col("documents") > most)
        shared = shared.join(counted.select("h", "g"), ["h", "g"], "left_semi")
    lost = shared.where("at > first")
    gone = lost.groupBy("at", "version").agg(F.collect_set("place").alias("gone"))

    met = own.join(gone, ["at", "version"], "left").withColumn("lines", _lines(F.col("body")))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    met = met.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("lost"), F.when(F.col("gone").isNull(), F.coalesce("body", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("left"))
    columns = [F.col("left").alias(c) if c == "text" else field("row", c) for c in names]
    return met.select(*columns, "n_lines", F.greatest(F.col("lost"), F.lit(0)).cast("long").alias("n_dropped"))
