"""Axis ticks and label places as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.functions import text
from curvemill.operators.chart import to_pixel

_ROUND = (1.0, 2.0, 2.5, 5.0)


def tick_step(lo: Column, hi: Column, n: int) -> Column:
    """The least of 1, 2, 2.5, 5 or 10 times a power of ten that makes at most about n ticks."""
    raw = (hi - lo) / (n - 1)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    step = F.when(power * _ROUND[0] >= raw, power * _ROUND[0])
    for m in _ROUND[1:]:
        step = step.when(power * m >= raw, power * m)
    return step.otherwise(power * 10.0)


def nice_ticks(lo: Column, hi: Column, n: int) -> Column:
    """An array of round values from lo to hi; the bound itself if they are equal, nothing for infinite or missing bounds."""
    none = F.array().cast("array<double>")
    if n < 2:
        return none
    finite = ~(F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")))
    lo1, hi1 = F.when(finite & (hi > lo), lo), F.when(finite & (hi > lo), hi)

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """What follows from a value that is computed once a row, not wherever it is used."""
        return F.transform(F.array(value), then)[0]

    def spread(b: Column) -> Column:
        step, first, end = b["step"], b["first"], b["end"]
        count = F.floor((end - first) / step).cast("int")
        values = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: first + i * step)
        values = F.filter(values, lambda t: t <= end)
        return F.transform(values, lambda t: F.when(F.abs(t) < step * 1e-9, 0.0).otherwise(t))

    bound = lambda step: F.struct(step.alias("step"), (F.ceil(lo1 / step).cast("double") * step).alias("first"), (hi1 + step * 1e-9).alias("end"))
    snapped = once(tick_step(lo1, hi1, n), lambda step: once(bound(step), spread))
    return F.when(finite & (hi > lo), snapped).when(finite & (hi <= lo), F.array(lo)).otherwise(none)


def y_ticks(ranges: DataFrame, plot_h: int, log_y: bool = False) -> DataFrame:
    """(tick, row, label) of a y axis plot_h rows high, from (vmin, vmax); on a log axis labels are powers of ten."""
    ticks = ranges.select("vmin", "vmax", F.explode(nice_ticks(F.col("vmin"), F.col("vmax"), max(plot_h // 4, 3))).alias("tick"))
    dot = to_pixel(F.col("tick"), F.col("vmin"), F.col("vmax"), plot_h * 4 - 1)
    row = F.greatest(F.least(F.floor(dot / 4), F.lit(plot_h - 1)), F.lit(0)).cast("int")
    shown = F.pow(F.lit(10.0), F.col("tick")) if log_y else F.col("tick")
    return ticks.select("tick", row.alias("row"), F.left(text.number(shown), F.lit(9)).alias("label"))


def x_labels(ranges: DataFrame, plot_w: int, mode: str) -> DataFrame:
    """(i, x, label, at) of an x axis plot_w cells wide, from (lo, hi); at counts cells from the axis, and the last label ends at the right."""
    n = max(plot_w // 22, 2)
    ticks = ranges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    part = F.col("i") / float(n)
    named = ticks.select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("x"), part.alias("part")).withColumn("label", text.x_value(F.col("x"), mode))
    width = F.char_length("label")
    place = F.floor(F.col("part") * (plot_w - 1)).cast("int") - F.when(F.col("i") == n, width).otherwise(0)
    last = F.greatest(F.lit(plot_w) - width - 1, F.lit(0))
    return named.select("i", "x", "label", F.greatest(F.least(place, last), F.lit(0)).cast("int").alias("at"))
