"""Connected components of a link table, by alternating large and small stars; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.shared import small, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v)."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = small(stored(least.select("u", F.least("u", "m").alias("m")), "stars"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = small(stored(edges.groupBy("u").agg(F.min("v").alias("m")), "stars"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): each linked node with the smallest node it hangs together with."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    state = None
    while True:
        for large in (True, False):
            edges = stored(_stars(edges, large).where("u <> v").distinct(), "edges")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
