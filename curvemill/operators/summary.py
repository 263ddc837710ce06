"""Series summaries: one row a series, which can be merged, instead of scans over points.

A summary has how many points were offered, the stride they are thinned by, the least wall time of all of them, and the first and the last kept point by step. Headers, x domains, lists of
tags and the longest series follow from summaries alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.operators.catalog import filter_tags
from curvemill.operators.thin import stride_of
from curvemill.schema import RELTIME, STEP

END = "struct<step:bigint,arrival_index:bigint,wall:double>"
SERIES = f"run string, tag string, offered long, stride long, least_wall double, first {END}, last {END}"


def offered(points: DataFrame) -> DataFrame:
    """(run, tag, n, wall): how many points each series gets, and their least wall time that is not 0."""
    return points.groupBy("run", "tag").agg(F.count("*").alias("n"), F.min(F.when(F.col("wall") != 0, F.col("wall"))).alias("wall"))


def counted(known: DataFrame, more: DataFrame, cap: int) -> DataFrame:
    """The summaries' counts after more points (``offered``) came: adds before, how many were offered until then, and grown, whether the stride of known points did."""
    both = known.withColumnRenamed("stride", "old").join(more, ["run", "tag"], "full")
    total = (F.coalesce("offered", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long")
    both = both.select("run", "tag", total.alias("offered"), F.coalesce("offered", F.lit(0)).alias("before"), "old", F.least("least_wall", "wall").alias("least_wall"), "first", "last")
    return both.withColumn("stride", stride_of(F.col("offered"), cap)).withColumn("grown", F.coalesce(F.col("stride") > F.col("old"), F.lit(False)))


def ends(points: DataFrame) -> DataFrame:
    """(run, tag, first, last) of kept points, which have their arrival_index."""
    point = F.struct("step", "arrival_index", "wall")
    return points.groupBy("run", "tag").agg(F.min(point).alias("first"), F.max(point).alias("last"))


def stored(series: DataFrame) -> Column:
    return F.ceil(F.col("offered") / F.col("stride"))


def first_walls(series: DataFrame) -> DataFrame:
    """(run, first_wall): the least wall time of a run over all its tags."""
    return series.groupBy("run").agg(F.min("least_wall").alias("first_wall"))


def tags(series: DataFrame, table: DataFrame, part: str = "") -> DataFrame:
    """The distinct tags of the enabled runs that contain part, by name."""
    own = series.join(table.where("enabled").select("run"), "run", "left_semi")
    return filter_tags(own.select("tag").distinct(), part).orderBy("tag")


def header(series: DataFrame, table: DataFrame, part: str = "") -> DataFrame:
    """(runs_on, runs_total, n_tags, total_points, stored_points, max_stride), one row."""
    counts = table.agg(F.count_if("enabled").alias("runs_on"), F.count("*").alias("runs_total"))
    shown = tags(series, table, part).agg(F.count("*").alias("n_tags"))
    points = series.agg(
        F.coalesce(F.sum("offered"), F.lit(0)).cast("long").alias("total_points"), F.coalesce(F.sum(stored(series)), F.lit(0)).cast("long").alias("stored_points"),
        F.coalesce(F.max("stride"), F.lit(1)).alias("max_stride"),
    )
    return counts.crossJoin(shown).crossJoin(points)  # one row each


def domain(series: DataFrame, x_mode: str, first: DataFrame | None = None) -> DataFrame:
    """(xmin, xmax) of the series, one row: from their first and last points by step; ``first`` has the first wall times of the runs."""
    x = lambda end: F.col(f"{end}.step").cast("double") if x_mode == STEP else F.col(f"{end}.wall")
    if x_mode == RELTIME:
        own = series.join(first if first is not None else first_walls(series), "run", "left")
        origin = F.coalesce("first_wall", "first.wall")
        return own.agg(F.min(x("first") - origin).alias("xmin"), F.max(x("last") - origin).alias("xmax"))
    return series.agg(F.min(x("first")).alias("xmin"), F.max(x("last")).alias("xmax"))


def longest(series: DataFrame) -> DataFrame:
    """The longest series as stored; of equals the last by name."""
    return series.select("run", "tag", stored(series).cast("long").alias("n_points")).orderBy(F.desc("n_points"), F.desc("run"), F.desc("tag")).limit(1)
