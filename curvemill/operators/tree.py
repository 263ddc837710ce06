"""The hierarchy of tags: a compressed prefix tree as a table, without recursion.

Every prefix of every tag is a node. A node stays if it is a tag, if it has not exactly one child, or if its only child is tag
and group at once; other nodes are folded into what follows, so a row's label is the part of its path below its nearest kept ancestor.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_path(tag: Column) -> Column:
    """The segments of a tag; empty ones do not count."""
    return F.filter(F.split(tag, "/"), lambda s: s != "")


def nodes(tags: DataFrame) -> DataFrame:
    """(seg, path, is_tag, tag, leaves, children, deep): all nodes of the full tree over the distinct tags."""
    parts = tags.select("tag", split_path(F.col("tag")).alias("seg")).distinct().where(F.size("seg") > 0)
    # tags that differ in empty segments only are one node; it keeps the least of them
    parts = parts.groupBy("seg").agg(F.min("tag").alias("tag"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda n: F.slice("seg", 1, n)))
    rows = parts.select("tag", "seg", prefix.alias("prefix"))
    child = F.when(F.size("seg") > F.size("prefix"), F.get("seg", F.size("prefix")))
    grouped = rows.groupBy("prefix").agg(
        F.max(F.when(F.size("seg") == F.size("prefix"), F.col("tag"))).alias("tag"), F.count("*").alias("leaves"),
        F.count_distinct(child).alias("children"), F.min(F.when(child.isNotNull(), F.concat("prefix", F.array(child)))).alias("only"),
    )
    return grouped.select(F.col("prefix").alias("seg"), F.array_join("prefix", "/").alias("path"), F.col("tag").isNotNull().alias("is_tag"), "tag", "leaves", "children", "only")


def compressed(tags: DataFrame) -> DataFrame:
    """(path, label, depth, leaf, leaves, tag, seg, above) of every kept node; above has the paths of its kept ancestors, root first."""
    full = nodes(tags)
    both = full.where(F.col("is_tag") & (F.col("children") > 0)).select(F.col("seg").alias("only"), F.lit(True).alias("both"))
    kept = full.join(both, "only", "left").where(F.col("is_tag") | (F.col("children") != 1) | F.coalesce("both", F.lit(False)))
    kept = kept.select("seg", "path", "tag", "is_tag", "leaves", (F.col("children") == 0).alias("leaf"))
    ups = kept.select("seg", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda n: F.slice("seg", 1, n))).alias("up")).where("size(up) < size(seg)")
    names = kept.select(F.col("seg").alias("up"), F.col("path").alias("up_path"))
    above = ups.join(names, "up").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct(F.size("up").alias("n"), F.col("up_path").alias("path")))).alias("ups"))
    rows = kept.join(above, "seg", "left").withColumn("ups", F.coalesce("ups", F.array().cast("array<struct<n:int,path:string>>")))
    depth = F.size("ups")
    skip = F.when(depth > 0, F.element_at("ups", F.lit(-1))["n"]).otherwise(0)
    label = F.array_join(F.slice("seg", skip + 1, F.size("seg") - skip), "/")
    return rows.select("path", label.alias("label"), depth.alias("depth"), "leaf", "leaves", "tag", "seg", F.transform("ups", lambda u: u["path"]).alias("above"))


def with_state(rows: DataFrame, state: Mapping[str, bool] | None = None, force_open: bool = False) -> DataFrame:
    """Adds expanded: as chosen in state, else open at depth 0; a filter forces all open. And visible: all kept ancestors are expanded."""
    chosen = F.create_map(*[F.lit(v) for kv in (state or {}).items() for v in kv]) if state else F.create_map().cast("map<string,boolean>")
    pick = lambda path, outermost: F.lit(True) if force_open else F.coalesce(F.element_at(chosen, path), outermost)
    ups = F.transform("above", lambda path, i: pick(path, i == 0))
    return rows.withColumn("expanded", ~F.col("leaf") & pick(F.col("path"), F.col("depth") == 0)).withColumn("visible", F.forall(ups, lambda x: x))


def visible_rows(tags: DataFrame, state: Mapping[str, bool] | None = None, force_open: bool = False) -> DataFrame:
    """The rows shown, in pre-order: each path segment by bytes."""
    shown = with_state(compressed(tags), state, force_open).where("visible")
    return shown.select("depth", "label", "path", "leaf", "leaves", "expanded", "tag", "seg").orderBy("seg").drop("seg")


def first_leaves(tags: DataFrame) -> DataFrame:
    """(path, first_tag): for each row of the tree the tag that selecting it shows, a row that is a tag itself or else its first by name."""
    leaf = tags.select("tag", split_path(F.col("tag")).alias("seg")).distinct().where(F.size("seg") > 0)
    below = leaf.select("tag", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda n: F.array_join(F.slice("seg", 1, n), "/"))).alias("path"), F.array_join("seg", "/").alias("own"))
    picked = below.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("own") == F.col("path"), F.col("tag"))), F.min("tag")).alias("first_tag"))
    return compressed(tags).select("path").join(picked, "path")


def parent_of(rows: DataFrame) -> DataFrame:
    """(path, parent): the nearest kept ancestor of each row, null at the top."""
    return rows.select("path", F.when(F.size("above") > 0, F.element_at("above", F.lit(-1))).alias("parent"))
