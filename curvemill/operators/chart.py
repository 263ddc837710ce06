"""A chart as a query: bucket means, smoothing, log axis, ranges and pixels. Built-in functions only.

The order of the steps bounds the work: points are filtered by x and averaged into at most ``ncols`` buckets a run by a partial
and a final aggregation; everything after that handles runs times columns rows, whatever the number of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.operators import series
from curvemill.schema import RELTIME, STEP, Chart


def bucket_of(x: Column, x0: Column, x1: Column, ncols: int) -> Column:
    """The column of x in [x0, x1]. Column c owns (edge(c-1), edge(c)], edge(c) = x0 + span * (c+1) / ncols, and column 0 owns x0 too.

    The guess by division can be off by one against the edges as computed, so it is corrected on both sides. Null if x lies beyond
    the last edge, which rounding may put below x1. An empty span is the middle column.
    """
    span = x1 - x0
    n = F.lit(float(ncols))
    edge = lambda c: x0 + span * (c + 1) / n
    guess = F.greatest(F.ceil((x - x0) * n / F.when(span > 0, span)).cast("double") - 1, F.lit(0.0))
    down = F.when((guess > 0) & (x <= edge(guess - 1)), guess - 1).otherwise(guess)
    exact = F.when(x > edge(down), down + 1).otherwise(down)
    return F.when(span <= 0, F.lit(ncols // 2)).when(exact < n, exact.cast("int"))


def bucket_means(xs: DataFrame, ncols: int, lo: Column | float, hi: Column | float) -> DataFrame:
    """(run, tag, col, y): the mean value of each non-empty column; both ends of the range count."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    if ncols <= 0:
        return xs.select("run", "tag", F.lit(0).alias("col"), F.col("value").alias("y")).limit(0)
    inside = xs.where((F.col("x") >= lo) & (F.col("x") <= hi)).withColumn("col", bucket_of(F.col("x"), lo, hi, ncols))
    return inside.where(F.col("col").isNotNull()).groupBy("run", "tag", "col").agg(F.avg("value").alias("y"))


def smooth(buckets: DataFrame, weight: float) -> DataFrame:
    """Debiased exponential moving average over the non-empty columns of each series; series of one column stay as they are.

    The array that is folded has one item a column, never one a point.
    """
    if weight <= 0:
        return buckets
    w = F.lit(float(weight))
    cells = F.array_sort(F.collect_list(F.struct("col", "y")))
    state = "struct<last:double,power:double,out:array<struct<col:int,y:double>>>"
    start = F.struct(F.lit(0.0).alias("last"), F.lit(1.0).alias("power"), F.array().cast("array<struct<col:int,y:double>>").alias("out")).cast(state)

    def step(s: Column, cell: Column) -> Column:
        last, power = s["last"] * w + (1 - w) * cell["y"], s["power"] * w
        here = F.struct(cell["col"].alias("col"), (last / (1 - power)).alias("y"))
        return F.struct(last.alias("last"), power.alias("power"), F.concat(s["out"], F.array(here)).alias("out")).cast(state)

    gathered = buckets.groupBy("run", "tag").agg(cells.alias("cells"))
    done = F.when(F.size("cells") < 2, F.col("cells").cast("array<struct<col:int,y:double>>")).otherwise(F.aggregate("cells", start, step, lambda s: s["out"]))
    return gathered.select("run", "tag", F.inline(done))


def log_y(buckets: DataFrame) -> DataFrame:
    """Positive values only, as decimal logarithms; NaN is not positive here."""
    return buckets.where((F.col("y") > 0) & ~F.isnan("y")).withColumn("y", F.log10("y"))


def y_range(buckets: DataFrame) -> DataFrame:
    """(vmin, vmax) of all drawn columns, one row: NaN ignored, padded by 5 %, or around a flat line by a tenth of its height or by 1."""
    real = F.when(~F.isnan("y"), F.col("y"))
    raw = buckets.agg(F.min(real).alias("a"), F.max(real).alias("b"))
    flat = (F.col("b") - F.col("a")) < 1e-12
    pad = F.when(flat, F.when(F.col("b") != 0, F.abs("b") * 0.1).otherwise(1.0)).otherwise((F.col("b") - F.col("a")) * 0.05)
    return raw.select((F.col("a") - pad).alias("vmin"), (F.col("b") + pad).alias("vmax"))


def to_pixel(y: Column, vmin: Column, vmax: Column, py_max: int) -> Column:
    """The dot row of y, 0 on top; NaN lies at the bottom."""
    rows = F.round((y - vmin) / (vmax - vmin) * F.lit(float(py_max)))
    return F.when(F.isnan(y), F.lit(py_max)).otherwise(F.lit(py_max) - F.when(~F.isnan(rows), rows).otherwise(0.0).cast("long")).cast("long")


def segments(pixels: DataFrame) -> DataFrame:
    """(run, tag, px0, py0, px1, py1): the lines between neighbouring columns of a run; the first column is a dot onto itself."""
    before = F.lag(F.struct("px", "py")).over(Window.partitionBy("run", "tag").orderBy("px"))
    both = pixels.withColumn("p", before)
    return both.select("run", "tag", F.coalesce("p.px", "px").alias("px0"), F.coalesce("p.py", "py").alias("py0"), F.col("px").alias("px1"), F.col("py").alias("py1"))


def curves(points: DataFrame, chart: Chart, first: DataFrame | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(run, tag, col, y): what a chart draws of the enabled runs' points.

    ``first`` gives the runs' first wall times for relative time; without it they are taken from points. ``bounds`` is the shown range of x where it is known
    (from summaries); then it is a condition on the points' own columns, which reaches a sorted table's scan, and no domain is computed.
    """
    first = first if first is not None else series.first_walls(points) if chart.x_mode == RELTIME else None
    own = points.where(F.col("tag") == chart.tag)
    if bounds is None:
        xs = series.with_x(own, chart.x_mode, first)
        shown = series.view_range(series.domain(xs), chart.view)  # one row
        placed, lo, hi = xs.crossJoin(F.broadcast(shown.select("lo", "hi"))), F.col("lo"), F.col("hi")
    else:
        lo, hi = bounds
        if chart.x_mode == STEP:
            own = own.where(F.col("step").between(max(math.ceil(lo), -(1 << 63)), min(math.floor(hi), (1 << 63) - 1)))
        elif chart.x_mode != RELTIME:
            own = own.where(F.col("wall").between(lo, hi))
        placed = series.with_x(own, chart.x_mode, first)
    drawn = smooth(bucket_means(placed, chart.px_w, lo, hi), chart.smoothing)
    return log_y(drawn) if chart.log_y else drawn


def pixels(drawn: DataFrame, px_h: int) -> DataFrame:
    """(run, tag, px, py) of drawn columns, scaled to their common padded range."""
    placed = drawn.crossJoin(F.broadcast(y_range(drawn)))  # one row
    return placed.select("run", "tag", F.col("col").alias("px"), to_pixel(F.col("y"), F.col("vmin"), F.col("vmax"), px_h - 1).alias("py"))
