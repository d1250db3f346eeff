"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import kept, remove_kept


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (a, b).

    Each round points every node at the least of itself and its neighbours and
    replaces links by links between those; rounds go on until none is left. A
    round at least halves the linked nodes, and every table of a round is
    written to the shared folder, so no plan grows and no links reach the driver.
    """
    edges = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = held = None  # held: the table that label reads
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        points = kept(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("parent")), "points")
        of_a, of_b = points.toDF("a", "pa"), points.toDF("b", "pb")
        moved = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        left = kept(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if label is None:
            label, held = points.withColumnRenamed("parent", "component"), points
        else:
            known = points.select(F.col("node").alias("component"), "parent")
            new = kept(label.join(known, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            remove_kept(held, points)
            label = held = new
        remove_kept(edges)
        edges = left
    if label is None:
        return edges.toDF("node", "component")
    remove_kept(edges)
    return label
