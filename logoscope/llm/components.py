"""Connected components of a link table, by alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). Every step is joins and aggregations with map-side
combining; the links are cut to the shared folder after each round, and nothing but a change count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over directed rows (a, b): links the neighbours of each node a to the least node around it."""
    if large:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        keep = F.col("b") > F.col("a")
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        keep = F.lit(True)
    least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = near.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least node of the component of every node in ``links`` (a, b), as a table of the shared folder.

    Loops and repeated links are harmless; rows with a null end are ignored; no links give no rows."""
    with Workspace(links.sparkSession, "components") as tables:
        links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = tables.written(links, "links")
        while True:
            stars = tables.written(_star(_star(links, True), False), "links")
            tables.drop(links)
            links = stars
            # done when every node points to its root: no node is both a child and a parent, none has two parents
            parents = stars.groupBy("a").agg(F.count("*").alias("n"))
            deep = parents.where("n > 1").select("a").union(stars.select(F.col("b").alias("a")).join(parents.select("a"), "a", "left_semi"))
            if not deep.limit(1).count():
                break
        roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
        return tables.kept(links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), "component-of")
