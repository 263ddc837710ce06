"""Series of points: x axes, domains, order, as-of lookup and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.schema import ARRIVAL, RELTIME, STEP, View


def order_key() -> Column:
    """Points of a series in order: by step, ties as they arrived."""
    return F.struct("step", *ARRIVAL)


def sorted_series(points: DataFrame) -> DataFrame:
    return points.orderBy("run", "tag", "step", *ARRIVAL)


#: Steps, or units of a table's arrival order, that one task looks at together.
CHUNK = 1 << 20
#: Points of a table in a chunk of its arrival order, where these are sparse.
CHUNK_POINTS = 1 << 18


def numbered(points: DataFrame) -> DataFrame:
    """Adds place, from 1, of each point in its series, in order of steps.

    Points are numbered within ranges of ``CHUNK`` steps, and ranges by what stands before them, so no task sorts a whole series.
    """
    chunked = points.withColumn("chunk", F.floor(F.col("step") / CHUNK))
    key = ["run", "tag", "chunk"]
    before = Window.partitionBy("run", "tag").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(order_key()))
    return chunked.join(starts, key).withColumn("place", F.col("start") + inside).drop("chunk", "start")


def backward_steps(points: DataFrame) -> DataFrame:
    """(run, tag, backwards): how many points of each series arrived after a later step.

    Points are compared within chunks of their files, and the first of each chunk with the last of the chunk before it. Chunks are as wide as ``CHUNK_POINTS`` points are on
    average, ``CHUNK`` at least, so there are few of them however sparse the arrival numbers.
    """
    at = F.col("rec_off").cast("double")
    width = F.greatest(F.lit(float(CHUNK)), (F.col("high") - F.col("low")) * CHUNK_POINTS / F.col("n"))
    facts = points.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))
    chunked = points.crossJoin(F.broadcast(facts)).withColumn("chunk", F.floor((at - F.col("low")) / width)).drop("low", "high", "n")
    key = ["run", "tag", "path", "chunk"]
    back = chunked.withColumn("before", F.lag("step").over(Window.partitionBy(*key).orderBy("rec_off", "val_idx")))
    at = F.struct("rec_off", "val_idx")
    each = back.groupBy(*key).agg(F.count_if(F.col("step") < F.col("before")).alias("inside"), F.min_by("step", at).alias("first"), F.max_by("step", at).alias("last"))
    edge = F.lag("last").over(Window.partitionBy("run", "tag").orderBy("path", "chunk"))
    return each.withColumn("edge", edge).groupBy("run", "tag").agg((F.sum("inside") + F.count_if(F.col("first") < F.col("edge"))).alias("backwards"))


def first_walls(points: DataFrame) -> DataFrame:
    """(run, first_wall): the least wall time of a run over all its tags; 0 means absent and does not count."""
    return points.groupBy("run").agg(F.min(F.when(F.col("wall") != 0, F.col("wall"))).alias("first_wall"))


def with_x(points: DataFrame, x_mode: str, first: DataFrame | None = None) -> DataFrame:
    """Adds x by step, wall time or time since the run's first wall time.

    ``first`` has the first wall times of the runs (of all tags, not only those in points). A run without any
    starts at the wall time of its series' first point.
    """
    if x_mode == STEP:
        return points.withColumn("x", F.col("step").cast("double"))
    if x_mode != RELTIME:
        return points.withColumn("x", F.col("wall"))
    runs = first if first is not None else first_walls(points)
    starts = points.groupBy("run", "tag").agg(F.min_by("wall", order_key()).alias("own_first"))
    starts = starts.join(runs, "run", "left").select("run", "tag", F.coalesce("first_wall", "own_first").alias("origin"))
    return points.join(starts, ["run", "tag"]).withColumn("x", F.col("wall") - F.col("origin")).drop("origin")


def domain(xs: DataFrame) -> DataFrame:
    """(xmin, xmax) over all series, one row: from the first and last points in step order, not from least and greatest x."""
    ends = xs.groupBy("run", "tag").agg(F.min_by("x", order_key()).alias("first"), F.max_by("x", order_key()).alias("last"))
    return ends.agg(F.min("first").alias("xmin"), F.max("last").alias("xmax"))


def view_range(bounds: DataFrame, view: View) -> DataFrame:
    """Adds lo and hi, the part of the domain that a view shows; never empty but by rounding."""
    span = F.greatest(F.col("xmax") - F.col("xmin"), F.lit(1e-12))
    lo, hi = F.col("xmin") + span * F.lit(float(view.lo)), F.col("xmin") + span * F.lit(float(view.hi))
    return bounds.withColumn("lo", lo).withColumn("hi", F.when(hi > lo, hi).otherwise(lo + F.lit(1e-12)))


def cursor_x(bounds: DataFrame, fraction: float, px_w: int) -> DataFrame:
    """Adds cursor_x: the x of the dot column that the cursor stands on."""
    at = int(fraction * (px_w - 1))
    return bounds.withColumn("cursor_x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(float(at)) / F.lit(float(max(px_w - 1, 1))))


def as_of(xs: DataFrame, at: float | Column) -> DataFrame:
    """(run, tag, step, value): each series' last point with x not beyond ``at``; series that begin later have no row."""
    at = at if isinstance(at, Column) else F.lit(float(at))
    last = F.max_by(F.struct("step", "value"), F.struct("x", "step", *ARRIVAL))
    return xs.where(F.col("x") <= at).groupBy("run", "tag").agg(last.alias("last")).select("run", "tag", "last.step", "last.value")


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("run", "tag").agg(F.count("*").alias("n_points"))


def longest(points: DataFrame) -> DataFrame:
    """The longest series; of equals the last by name."""
    return lengths(points).orderBy(F.desc("n_points"), F.desc("run"), F.desc("tag")).limit(1)
