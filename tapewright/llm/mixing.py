"""Operator 3, mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import WORD, field, kept, whole_row

#: Seeds that are tried for each source.
SEEDS = 32
RESULTS = ("size", "source_size", "target", "copies", "taken")


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target: a row for each source of rows (source, size).

    Sources by code point, null last, take the weights in turn. They share the
    sum of all sizes by weight, but none gets more than `most` times its size;
    what is above goes to the others by weight. That fills all sources to one
    level (target = weight * level) except those that are full before. With
    sources in the order in which they fill, the level is the highest of
    (total - what is full before) / (weights not full before).
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, not for each document
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("full", most * F.col("source_size"))
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(F.lit(1))
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - before) / left)
    return levels.withColumn("target", F.least("full", F.col("weight") * F.max("level").over(whole))).select("source", "source_size", "target")


def draw(own: Column, seed: Column) -> Column:
    """A number from 0 up to 1 that depends on the document (its hash) and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(own, seed), 11) / float(1 << 53)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0, seed: int = 17, seeds: int = SEEDS) -> DataFrame:
    """docs with size, source_size, target, copies and taken (size * copies).

    Size: words in the text, null 0. rate = target / source_size. A document is
    taken floor(rate) times, and once more if its draw, a hash of its id and
    text and of the source's seed, is below the fraction of the rate. Of `seeds`
    seeds, which are the same for every source, a source takes the one whose
    taken words come nearest to its target (the first of equals); under each of
    them the chance of the copy is the fraction. So the draw of a document
    depends on no other document but by that choice. All of it is sums by
    source, made in part before rows are sent: a source of any share of the rows
    is as good as many small ones. The table of sources is written, so that its
    size is known and Spark sends it to the rows while it is small. Reruns agree.

    Rows that repeat each count and are drawn alike. A null source is a source.
    Sources without words have the rate 0. Columns of docs with one of the
    result's names are replaced; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    sized = docs.select(
        whole_row(docs, names).alias("row"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("own"),
    )
    targets = source_targets(sized.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select(F.col("source").alias("of"), "source_size", "target", F.floor(rate).cast("long").alias("times"), (rate - F.floor(rate)).alias("part"))
    plain = sized.select("source", "size", "own").join(rates, F.col("source").eqNullSafe(F.col("of")))
    sums = plain.groupBy("of").agg(*[F.sum(F.when(draw(F.col("own"), F.lit(seed + k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"k{k}") for k in range(seeds)], F.first("part").alias("part"), F.first("source_size").alias("n"))
    misses = F.array(*[F.struct(F.abs(F.col(f"k{k}") - F.col("part") * F.col("n")).alias("miss"), F.lit(seed + k).alias("seed")) for k in range(seeds)])
    chosen = kept(rates.join(sums.select(F.col("of").alias("source"), F.array_min(misses)["seed"].alias("seed")), F.col("of").eqNullSafe(F.col("source"))).drop("source"), "sources")

    met = sized.join(chosen, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("times") + (draw(F.col("own"), F.col("seed")) < F.col("part")).cast("long")
    return met.select(*[field("row", c) for c in names], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs. Texts are only shuffled where the table of sources is too large to send."""
    mixed = mix(docs.select(whole_row(docs, docs.columns).alias("row"), "doc_id", "source", "text"), **options)
    several = mixed.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return several.select(*[field("row", c) for c in docs.columns])
