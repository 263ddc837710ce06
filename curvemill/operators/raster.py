"""Lines to braille text: dots of each segment, cells and text rows.

A chart has runs times columns segments, each at most px_w + px_h dots long, so everything here is bounded by the screen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.operators.catalog import dash_covers


def line_dots(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The dots of an integer line as an array of (x, y), ends included: one dot a step along the longer side.

    The other coordinate is the exact rational position rounded to the nearest integer, halves away from the start, which is where the midpoint line algorithm goes.
    """
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    long, sx, sy = F.greatest(dx, dy), F.when(x1 >= x0, 1).otherwise(-1), F.when(y1 >= y0, 1).otherwise(-1)
    steps = F.sequence(F.lit(0).cast("long"), long.cast("long"))
    near = lambda i, d: F.floor((2 * i * d + long) / F.greatest(2 * long, F.lit(1)))
    return F.transform(steps, lambda i: F.struct((x0 + sx * near(i, dx)).cast("int").alias("x"), (y0 + sy * near(i, dy)).cast("int").alias("y")))


def dots(segments: DataFrame) -> DataFrame:
    """(run, px, py, phase): the dots of a run's polyline; phase counts dots along it, shared ends twice, after a first dot."""
    ends = [F.col(c).cast("long") for c in ("px0", "py0", "px1", "py1")]
    length = F.greatest(F.abs(ends[2] - ends[0]), F.abs(ends[3] - ends[1])) + 1
    before = Window.partitionBy("run").orderBy("px1", "px0").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("before", F.coalesce(F.sum(length).over(before), F.lit(0)))
    walked = placed.select("run", "before", F.posexplode(line_dots(*ends)).alias("i", "dot"))
    return walked.select("run", F.col("dot.x").alias("px"), F.col("dot.y").alias("py"), (F.col("before") + F.col("i")).alias("phase"))


def dashed(dots_: DataFrame, styles: DataFrame) -> DataFrame:
    """The dots that a run's dash pattern covers, with its color_slot."""
    return dots_.join(styles.select("run", "color_slot", "dash"), "run").where(dash_covers(F.col("dash"), F.col("phase"))).select("run", "px", "py", "phase", "color_slot")


def braille_bit(px: Column, py: Column) -> Column:
    """The bit of a dot within its cell of 2 by 4: the left column counts 1, 2, 4, 64, the right 8, 16, 32, 128."""
    row = F.pmod(py, F.lit(4)).cast("int")
    left = F.pmod(px, F.lit(2)) == 0
    bit = F.when(row < 3, F.pow(F.lit(2.0), row + F.when(left, 0).otherwise(3))).otherwise(F.when(left, 64.0).otherwise(128.0))
    return bit.cast("int")


def cells(dots_: DataFrame, px_w: int, px_h: int) -> DataFrame:
    """(row, cell, bits, color_slot, char): each cell with a dot; the last run to draw in a cell gives its colour."""
    inside = dots_.where(F.col("px").between(0, px_w - 1) & F.col("py").between(0, px_h - 1))
    if "color_slot" not in inside.columns:
        inside = inside.withColumn("color_slot", F.lit(0))
    grouped = inside.groupBy(F.floor(F.col("py") / 4).cast("int").alias("row"), F.floor(F.col("px") / 2).cast("int").alias("cell")).agg(
        F.bit_or(braille_bit(F.col("px"), F.col("py"))).alias("bits"), F.max_by("color_slot", F.struct("run", "phase")).alias("color_slot"),
    )
    char = F.decode(F.unhex(F.lpad(F.hex(F.lit(0x2800) + F.col("bits")), 4, "0")), "UTF-16BE")
    return grouped.withColumn("char", char)


def text_rows(cells_: DataFrame, plot_w: int, plot_h: int) -> DataFrame:
    """(row, line) of a plot: every row, blanks where no dot is."""
    spark = cells_.sparkSession
    by_row = cells_.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "char"))).alias("chars"))
    rows = spark.range(plot_h).select(F.col("id").cast("int").alias("row")).join(by_row, "row", "left")
    places = F.sequence(F.lit(0), F.lit(plot_w - 1))
    empty = F.create_map().cast("map<int,string>")
    line = F.array_join(F.transform(places, lambda i: F.coalesce(F.element_at(F.coalesce("chars", empty), i), F.lit(" "))), "")
    return rows.select("row", line.alias("line")).orderBy("row")
